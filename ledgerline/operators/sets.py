"""Row set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import named


def append_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def append_first(df: DataFrame, order: str, n: int) -> DataFrame:
    """Repeat the rows whose 0-based position column is below n."""
    return df.unionByName(df.filter(F.col(order) < n))


def dedupe(df: DataFrame) -> DataFrame:
    """Distinct rows; missing values equal each other."""
    return df.dropDuplicates()


def duplicate_totals(df: DataFrame) -> DataFrame:
    """One row: all rows and distinct rows. Copies are combined before the shuffle, which
    spreads by the whole row, so many copies of one row do not gather in one task."""
    copies = df.groupBy(*[named(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0).cast("bigint")).alias("total_records"),
        F.count(F.lit(1)).alias("unique_records"),
    )
