"""Arrow functions where Spark has none: Unicode folding and sequence similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without what isn't ASCII."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks; 0 where either side is null or empty. For pairs of distinct texts after blocking."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)], dtype="float64")


def register(spark) -> None:
    """Make both available to SQL."""
    spark.udf.register("ascii_fold", ascii_fold)
    spark.udf.register("sequence_ratio", sequence_ratio)
