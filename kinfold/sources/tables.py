"""Typed table scans."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are taken as UTC (watermarks need TIMESTAMP)."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
