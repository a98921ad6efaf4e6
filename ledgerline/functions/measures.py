"""Additive sales measures.

A tally is a frame with one row per key combination that holds only sums, counts and
extremes. Tallies can be merged on coarser keys, so rows are combined before each
shuffle and each join: however many rows share one key, at most one row per task for
that key travels further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("rows", "transactions", "amounts", "unit_rows")
SUMS = ("revenue", "units")


def tally(
    df: DataFrame, keys: list[str], transaction: str, amount: str, quantity: str
) -> DataFrame:
    """Fold raw rows into measures. The three SQL expressions are what counts as a
    transaction (null is not one), the money value and the number of items."""
    measures = [
        "count(1) as rows",
        f"count({transaction}) as transactions",
        f"count({amount}) as amounts",
        f"count({quantity}) as unit_rows",
        f"sum({amount}) as revenue",
        f"sum(cast({quantity} as bigint)) as units",
        f"max({amount}) as high",
        f"min({amount}) as low",
    ]
    return df.groupBy(*keys).agg(*map(F.expr, measures))


def merge(tallies: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Fold tallies onto coarser keys; extra aggregates see the finer rows."""
    measures = [
        *[f"coalesce(sum({c}), 0L) as {c}" for c in COUNTS],
        *[f"sum({c}) as {c}" for c in SUMS],
        "max(high) as high",
        "min(low) as low",
    ]
    return tallies.groupBy(*keys).agg(*map(F.expr, measures), *extra)


def revenue(digits: int | None = 2) -> Column:
    return F.col("revenue") if digits is None else F.round("revenue", digits)


def rounded_mean(total: Column, n: Column, digits: int | None = 2) -> Column:
    """total / n, null when n is 0. Rounding goes through decimals: a double sum depends
    on the order of its terms in the last place, which would tip exact ties either way."""
    mean = F.try_divide(total, n)
    if digits is None:
        return mean
    exact = F.try_divide(total.try_cast("decimal(30,6)"), n)
    return F.coalesce(F.round(exact, digits).cast("double"), F.round(mean, digits))


def mean_amount(digits: int | None = 2) -> Column:
    return rounded_mean(F.col("revenue"), F.col("amounts"), digits)


def mean_units(digits: int | None = 2) -> Column:
    return rounded_mean(F.col("units"), F.col("unit_rows"), digits)


def revenue_per_row(digits: int | None = 2) -> Column:
    """Revenue over all rows of the group, rows without an amount included."""
    return rounded_mean(F.col("revenue"), F.col("rows"), digits)
