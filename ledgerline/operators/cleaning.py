"""Row cleaning: empty rows, missing numbers, missing text, lineage columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import (
    lot,
    named,
    nan_to_null,
    numeric_columns,
    present,
    string_columns,
)
from ledgerline.functions.quantiles import exact_quantiles

# Fixed value: what a missing string becomes.
UNKNOWN = "Unknown"


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def _sketched_medians(df: DataFrame, columns: list[str], rank_error: float) -> dict[str, Column]:
    accuracy = round(1.0 / rank_error)
    medians = [
        F.percentile_approx(present(df, c), 0.5, accuracy).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    found = df.agg(F.struct(*medians)).scalar()
    return {c: found.getField(f"c{i}") for i, c in enumerate(columns)}


def _exact_medians(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Columns of one type share a search, so that every value keeps its type."""
    kinds: dict = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType, []).append(c)
    medians = {}
    for same in kinds.values():
        cells = [F.struct(F.lit(c).alias("name"), present(df, c).alias("value")) for c in same]
        long = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
        found = exact_quantiles(long, "value", {"median": 0.5}, ["name"], interpolate=False)
        wide = [
            F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"c{i}")
            for i, c in enumerate(same)
        ]
        row = found.agg(F.struct(*wide)).scalar()
        medians |= {c: row.getField(f"c{i}") for i, c in enumerate(same)}
    return medians


def impute_median(df: DataFrame, rank_error: float = 0.01) -> DataFrame:
    """Fill missing numbers (null or NaN) with the column's median, cast to its type.

    The median is the lowest value that at least half of the values do not exceed, within
    rank_error of the rows; 0 asks for the exact one. Columns of one type share a pass. A
    column without any value stays as it is.
    """
    columns = numeric_columns(df)
    if not columns:
        return df
    if rank_error > 0:
        medians = _sketched_medians(df, columns, rank_error)
    else:
        medians = _exact_medians(df, columns)
    return df.select(
        *[
            F.coalesce(present(df, c), medians[c]).alias(c) if c in medians else named(c)
            for c in df.columns
        ]
    )


def fill_unknown(df: DataFrame, value: str = UNKNOWN) -> DataFrame:
    texts = set(string_columns(df))
    return df.select(
        *[
            F.coalesce(named(c), F.lit(value)).alias(c) if c in texts else named(c)
            for c in df.columns
        ]
    )


def add_lineage(df: DataFrame, run_time: dt.datetime | None = None) -> DataFrame:
    """Add processing_timestamp and processing_date, now unless a run time is given."""
    moment = F.current_timestamp() if run_time is None else F.lit(run_time).cast("timestamp")
    return df.withColumns(
        {"processing_timestamp": moment, "processing_date": moment.cast("date")}
    )


def clean(df: DataFrame, rank_error: float = 0.01) -> DataFrame:
    """Drop empty rows, then fill numbers, then fill text."""
    return df.transform(drop_all_null).transform(impute_median, rank_error).transform(fill_unknown)


def with_constant(df: DataFrame, name: str, value: Any) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def with_line_amount(df: DataFrame, name: str = "total_amount") -> DataFrame:
    return df.withColumn(name, F.round(F.col("quantity") * F.col("unit_price"), 2))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def sample_fraction(
    df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42
) -> DataFrame:
    """About a fraction of the rows: those whose keys draw a number below it. The same rows
    from any partitioning or file order; rows with equal keys stay or go together."""
    return df.filter(lot(keys, seed) < F.lit(round(fraction * 2**32)).cast("bigint"))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer): those whose keys draw the least numbers, ties
    by the keys. Each task keeps n rows, so n is meant for what a plot can show."""
    drawn = df.withColumn("number drawn", lot(keys, seed))
    return drawn.orderBy("number drawn", *[named(k) for k in keys]).limit(n).drop("number drawn")


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    fraction: float = 1.0,
    seed: int = 42,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """The two columns of a scatter plot; a fraction below 1 samples the rows, by their keys
    if these are named (see sample_fraction), otherwise by what the two columns hold."""
    if fraction < 1.0:
        df = sample_fraction(df, keys or [x, y], fraction, seed)
    return nan_to_null(df.select(x, y))
