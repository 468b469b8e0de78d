"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.staging import shared_dir, stage, unstage  # noqa: F401  (the operators take them from here)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_col(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(n: int, sizes, most: int):
    """Ranges (a, b) of rows whose sizes add up to at most `most`, one row at least."""
    a, total = 0, 0
    for i in range(n):
        if i > a and total + sizes[i] > most:
            yield a, i
            a, total = i, 0
        total += int(sizes[i])
    if n > a:
        yield a, n
