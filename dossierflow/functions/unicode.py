"""Compatibility forms of texts (NFKC), for which Spark has no function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def with_nfkc(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """``df`` with the normal form of ``column`` in its place, or as ``out``.

    Only texts with a character outside ASCII go to Python, in Arrow batches;
    others, and nulls, are their own normal form and stay in the JVM. No row
    is shuffled; ``df`` is read twice, so it should be a table.
    """
    plain = F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True))
    same, other = df.where(plain), df.where(~plain)
    return same.withColumn(out or column, F.col(column)).unionByName(other.withColumn(out or column, nfkc(F.col(column))))


def by_table(df: DataFrame, column: str, out: str) -> DataFrame:
    """The same for columns of few distinct short texts, such as names: each distinct one is normalised once and joined back."""
    forms = with_nfkc(df.select(F.col(column).alias("__name")).where("__name is not null").distinct(), "__name", "__form")
    return df.join(forms, F.col(column) == F.col("__name"), "left").withColumn(out, F.col("__form")).drop("__name", "__form")
