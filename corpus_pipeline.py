"""Documents to training data in five stages: each applies one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import encode_chunked, vocabulary_path
from kinfold.llm.common import Tables, cut, documents, join_small, unused, write_table
from kinfold.llm.langid import fit_languages, identify_languages
from kinfold.llm.mixing import mix_sources
from kinfold.llm.ngram_join import near_duplicates
from kinfold.llm.quality import apply_quality, fit_quality, statistics


def _with_own_columns(docs: DataFrame, added: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after a step that adds columns: those of docs that are named alike stand aside meanwhile."""
    aside = {c: unused(docs, f"__own_{c}") for c in docs.columns if c in added}
    return step(docs.withColumnsRenamed(aside)).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; repeated rows get one verdict; other columns,
    those named as the rules' own too, pass. Empty table: empty result.

    A verdict hangs on text, lang and source alone. Statistics are written without texts, with two 64-bit hashes of the three,
    and rows go by the hashes of those rejected, so no copy of the texts stays on disk beside the result."""
    on = [unused(docs, f"__row{k}") for k in (1, 2)]
    known = [x for c in ("text", "lang", "source") for x in (F.col(c), F.col(c).isNull())]
    rows = docs.withColumns({c: F.xxhash64(F.lit(k), *known) for k, c in enumerate(on)})
    stats = write_table(statistics(rows.select("text", "lang", "source", *on)).drop("text"), "quality")
    rejected = cut(apply_quality(stats, fit_quality(stats)).filter("NOT kept").select(*on).distinct())
    return join_small(rows, rejected, on, "left_anti", max_rows=1_000_000, salts=8).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows with a posterior of a half or more; a missing lang is filled in.
    A table without any labelled document has no model, and all texts with a letter stay. Null and empty texts go; columns
    named as those that the operator adds pass. Empty table: empty result."""
    model = fit_languages(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    added = ["lang_pred", "score"]
    return _with_own_columns(docs, added, lambda d: identify_languages(d, model).filter("lang_pred <> 'und' AND score >= 0.5").withColumn("lang", F.coalesce("lang", "lang_pred")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates (five words, a similarity of 0.8). Equal rows of
    it are kept once; rows that share its doc_id and differ all stay, as do rows without a doc_id. Texts without words are
    like no other. Empty table: empty result. Texts aren't dealt while the documents that go are a million at most."""
    found = near_duplicates(docs, percent=80, width=5).filter("doc_id IS NOT NULL")
    other = cut(found.groupBy("doc_id").agg(F.count_if(F.expr("doc_id = component_id")).alias("rows")).filter("rows <> 1"))
    once = join_small(docs, other.select("doc_id"), ["doc_id"], "left_anti", max_rows=1_000_000, salts=1).select(*docs.columns)
    often = join_small(docs, other.filter("rows > 1").select("doc_id"), ["doc_id"], "left_semi", max_rows=1_000_000, salts=1)
    return once.unionByName(often.select(*docs.columns).distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source's share goes with the square root of its size, in random order. A null source is
    a source; null texts and repeated rows are repeated as any other; columns named copy or shuffle_key pass. Empty table:
    empty result."""
    return _with_own_columns(docs, ["copy", "shuffle_key"], mix_sources)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit integers) of every document, and whether the
    decoded ids are its text again (round_trip). Null and empty texts have no tokens; other columns go. Empty table: empty
    result."""
    out = encode_chunked(docs.select("doc_id", "text", "lang", "source"), vocabulary_path(), decode=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", keep_distinct),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes as soon as the next one is written."""
    docs, tables, before = documents(spark, sf_dir), Tables(spark, "pipeline"), []
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tables.drop(*before)
        before = [name.replace(" ", "-")]
    return docs


#: Stages hold tokenizers and fitted models, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
