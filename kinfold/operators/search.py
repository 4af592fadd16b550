"""R1 over an index: substrings of many texts by their trigrams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
#: Characters of a gram; terms without a run of as many letters that no wildcard breaks are looked for in all texts.
GRAM = 3


def _grams(text):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM))))


class TrigramIndex:
    """Texts (id, text; several of one id) under a path: the texts in order of id, postings (gram, id) in order of gram, and how
    many ids each gram has. A lookup reads the parts of the postings that may hold one gram, and the texts of its ids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, texts: DataFrame) -> TrigramIndex:
        """Rows without id or text are left out; texts of fewer than three characters have no postings."""
        rows = texts.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text").distinct()
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/texts")
        low = self.spark.read.parquet(f"{self.path}/texts").withColumn("low", F.lower("text"))
        postings = low.filter(F.length("low") >= GRAM).select("id", F.explode(_grams(C("low"))).alias("gram")).distinct()
        postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{self.path}/postings")
        counts = self.spark.read.parquet(f"{self.path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/counts")
        return self

    def candidates(self, term: str) -> DataFrame | None:
        """Ids of the texts that hold the rarest gram of a term; None if it has no gram."""
        low = self.spark.range(1).select(F.lower(F.lit(term)).alias("t")).first()["t"]
        grams = sorted({part[i : i + GRAM] for part in re.split(r"[%_\\]", low) for i in range(len(part) - GRAM + 1)})
        if not grams:
            return None
        known = {r.gram: r.n for r in self.spark.read.parquet(f"{self.path}/counts").filter(C("gram").isin(grams)).collect()}  # a term's grams
        rarest = min(grams, key=lambda g: (known.get(g, 0), g))
        return self.spark.read.parquet(f"{self.path}/postings").filter(C("gram") == rarest).select("id")

    def search(self, term: str) -> DataFrame:
        """Ids of the texts that contain a term in any case; % and _ are wildcards, as in ilike."""
        texts, some = self.spark.read.parquet(f"{self.path}/texts"), self.candidates(term)
        rows = texts if some is None else texts.join(some, "id", "left_semi")
        return rows.filter(C("text").ilike(f"%{term}%")).select("id").distinct()


def searched_texts(series: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, text): what a search of series (id, title, description) looks at: title, normalised title, description and aliases
    (series_id, alias)."""
    from kinfold.functions import text as T

    own = series.select("id", F.explode(F.array("title", T.normalize_title(C("title")), "description")).alias("text"))
    return own.unionByName(aliases.select(C("series_id").alias("id"), C("alias").alias("text"))).filter("text IS NOT NULL AND text <> ''")


def search_indexed(series: DataFrame, identities: DataFrame, index: TrigramIndex, term: str, sources: list[str]) -> DataFrame:
    """The series that an index of searched_texts finds, with an identity of one of the sources; all of them for a blank
    term, and of any source for no sources."""
    term = term.strip()
    found = series.join(index.search(term), "id", "left_semi") if term else series
    listed = identities.filter(C("source").isin(sources)).select(C("series_id").alias("id"))
    return found.join(listed, "id", "left_semi") if sources else found
