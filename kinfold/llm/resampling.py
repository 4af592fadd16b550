"""Importance resampling towards the distribution of a target, with Arrow's kernels.

Features are runs of words, hashed into buckets. Documents and target are counted by bucket; a bucket's gain is the
logarithm of its share in the target over its share in the documents. A document's weight is the sum of the gains of its
features, and noise of the Gumbel distribution on top of it makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import Tables, documents

#: What lies between words, in RE2 and as the bytes at which a long text may be cut.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CUTS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text that the kernels take at a time.
STEP_BYTES = 1 << 22


def _parts(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and their parts, about STEP_BYTES at a time; a long text has several parts, cut between words, and all
    of them in one list."""
    numbers, parts, size = [], [], 0
    for i, t in enumerate(texts):
        data = t.as_py() or ""
        size += len(data)
        if len(data) > STEP_BYTES:
            raw, at = np.frombuffer(data.encode(), np.uint8), 0
            while at < len(raw):
                end = min(len(raw), at + STEP_BYTES)
                found = np.flatnonzero(CUTS[raw[end : end + STEP_BYTES]])
                while end < len(raw) and not len(found):
                    end = min(len(raw), end + STEP_BYTES)
                    found = np.flatnonzero(CUTS[raw[end : end + STEP_BYTES]])
                end += int(found[0]) if len(found) else 0
                numbers.append(i)
                parts.append(raw[at:end].tobytes().decode())
                at = end
        else:
            numbers.append(i)
            parts.append(data)
        if size >= STEP_BYTES:
            yield numbers, parts
            numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def words_of(numbers: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word, the number of its text and its index; and the distinct words."""
    text, words = [], []
    for a in range(0, len(parts), 4096):
        lists = pc.split_pattern_regex(pc.ascii_lower(pa.array(parts[a : a + 4096], pa.string())), pattern=BETWEEN)
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        some = pc.not_equal(pc.binary_length(flat), 0)
        text.append(np.array(numbers[a : a + 4096], np.int64)[pc.filter(parent, some).to_numpy()])
        words.append(pc.filter(flat, some).dictionary_encode())
    coded = pa.chunked_array(words, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
    index = [c.indices.to_numpy() for c in coded.chunks]
    return np.concatenate(text), np.concatenate(index).astype(np.int64), coded.chunk(0).dictionary


def features(numbers: list[int], parts: list[str], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... `longest` words: the number of the text and the bucket of each run, in order of the texts.

    Runs are made of dictionary indices, shifted against each other; only distinct ones are spelt out and hashed."""
    text, index, words = words_of(numbers, parts)
    known = [w.encode() for w in words.to_pylist()]
    here, spelt = index, known  # the run that begins at each word, and the spelling of each run
    inside = np.ones(len(index), bool)
    for n in range(1, longest + 1):
        if n > 1:
            at = max(0, len(index) - n + 1)
            inside = text[:at] == text[len(text) - at :]
            runs, here = np.unique(np.where(inside, here[:at] * len(known) + index[len(index) - at :], -1), return_inverse=True)
            spelt = [spelt[r // len(known)] + b" " + known[r % len(known)] if r >= 0 else b"" for r in runs.tolist()]
        crc = np.fromiter((zlib.crc32(s) % buckets for s in spelt), np.int64, len(spelt))
        yield text[: len(inside)][inside], crc[here[inside]]


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features by bucket in the column text of all rows: each task sends a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for numbers, parts in _parts(batch.column("text")):
                for _, found in features(numbers, parts, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's share over the corpus's of each bucket, with one more count in each."""
    s, t, m = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def importance(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the gains of its features) of each row of docs (doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(gain, pa.int64())
        for batch in batches:
            doc_id, at = batch.column("doc_id"), 0
            for numbers, parts in _parts(batch.column("text")):
                size = numbers[-1] + 1 - at
                n_words, n_features, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
                for n, (text, found) in enumerate(features([i - at for i in numbers], parts, longest, len(gain))):
                    if len(text):
                        first = np.flatnonzero(np.diff(text, prepend=-1))
                        count = np.diff(first, append=len(text))
                        n_features[text[first]] += count
                        weight[text[first]] += np.add.reduceat(table.take(pa.array(found)).to_numpy(), first)
                        if n == 0:
                            n_words[text[first]] = count
                yield pa.RecordBatch.from_arrays([doc_id.slice(at, size), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
                at += size

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, tables: Tables, longest: int = 2, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text): the floor(percent * N / 100) highest
    scores of the N texts with least_words words or more have ranks 1, 2, ..., the others none.

    Features are all runs of 1 to `longest` words of letters, digits and characters beyond ASCII, A-Z in lower case; target
    has a column text. Ties go to the smaller doc_id, a row without one last; equal rows have ranks of their own, in any order.
    Null and empty texts have no feature and a weight of 0, in docs as in target; an empty target counts as one of equal
    shares. Texts of any length are taken whole. Other columns are ignored. Empty table: empty result. Tables of `tables`,
    which the result reads: `weighed` and `drawn`.

    Ranks come from a range partitioning of the scores: rows are numbered within each partition, and the sizes of the
    partitions before it are added.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    weighed = importance(docs, gain, longest)
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    weighed = tables.write(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln(u)))), "weighed")
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    drawn = percent * weighed.filter(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = weighed.filter(able).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = tables.write(ranged.withColumn("at", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).toPandas().sort_values("part")  # a row a partition
    before = docs.sparkSession.createDataFrame(list(zip(sizes["part"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist())), "part bigint, before bigint")
    rank = F.col("before") + F.col("place") + 1
    ranged = ranged.withColumns({"part": part, "place": place}).join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranged.select(*names).unionByName(weighed.filter(~able).withColumn("rank", F.lit(None).cast("long")).select(*names))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents drawn towards the words of benchmark; cases as in resample."""
    tables = Tables(spark, "resampling")
    docs, target = documents(spark, sf_dir), spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    out = tables.write(resample(docs, target, tables, longest=1), "resampled")
    tables.drop("weighed", "drawn")
    return out
