"""Helpers that the training-data operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import Tables, cut, fresh_path, shared_dir, write_table

__all__ = ["SPACE", "Tables", "cut", "documents", "fresh_path", "join_small", "let", "shared_dir", "unused", "word_list", "write_table"]

#: Java pattern of the white space between words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """Join a table of few rows per key: broadcast if a count proves it has max_rows at most; else a shuffle join in which
    every key of the big side is dealt over salts, so that a key with a third of all rows spreads out. `small` has one row a
    key; max_rows is for rows of some 200 bytes, and callers with wider or narrower ones give their own."""
    if small.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    if salts == 1:  # a key of the big side has few rows
        return big.join(small, on, how)
    salted = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; a plain reference inside a lambda may be computed once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def word_list(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
