"""Rule-driven data quality: completeness, uniqueness, validity, consistency.

Completeness, validity and consistency come from one scan that yields a single row of
counters; uniqueness is the only test that has to shuffle rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import named, present
from ledgerline.operators.sets import duplicate_totals
from ledgerline.sources.generators import PAYMENT_CATEGORIES, PAYMENT_METHODS

Range = tuple[float | None, float | None]


@dataclass(frozen=True)
class QualityRules:
    """Shares of rows that may be missing or duplicated, value ranges and allowed values."""

    # The rules for payments.
    max_missing: float = 0.05
    max_duplicates: float = 0.01
    ranges: Mapping[str, Range] = field(
        default_factory=lambda: {"amount": (0, 10000), "customer_id": (1, None)}
    )
    allowed: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "category": PAYMENT_CATEGORIES,
            "payment_method": PAYMENT_METHODS,
        }
    )
    # What a report calls the check of a column, where not by the column's name.
    names: Mapping[str, str] = field(default_factory=lambda: {"amount": "amount_range"})


PAYMENT_RULES = QualityRules()


def outside(column: Column, bounds: Range) -> Column:
    """Below the minimum or above the maximum; a missing value is not a violation."""
    low, high = bounds
    tests = []
    if low is not None:
        tests.append(column < low)
    if high is not None:
        tests.append(column > high)
    result = F.lit(False)
    for test in tests:
        result = result | F.coalesce(test, F.lit(False))
    return result


def not_allowed(column: Column, values: Sequence[str]) -> Column:
    """Not in the list; a missing value is a violation."""
    return ~F.coalesce(column.isin(*values), F.lit(False))


def _counters(df: DataFrame, rules: QualityRules) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.struct(*[F.count_if(present(df, c).isNull()).alias(c) for c in df.columns]).alias(
            "missing"
        ),
        F.struct(
            F.lit(0).alias("_"),
            *[F.count_if(outside(present(df, c), b)).alias(c) for c, b in rules.ranges.items()],
        ).alias("out_of_range"),
        F.struct(
            F.lit(0).alias("_"),
            *[F.count_if(not_allowed(named(c), v)).alias(c) for c, v in rules.allowed.items()],
        ).alias("disallowed"),
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100


def _complete(column: str, rules: QualityRules) -> Column:
    percent = _percent(F.col("missing").getField(column), F.col("rows"))
    return percent <= rules.max_missing * 100


def _unique(total: Column, distinct: Column, rules: QualityRules) -> Column:
    return _percent(total - distinct, total) <= rules.max_duplicates * 100


def completeness(df: DataFrame, rules: QualityRules = PAYMENT_RULES) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("missing").getField(c).alias("missing_count"),
            _percent(F.col("missing").getField(c), F.col("rows")).alias("missing_percentage"),
            _complete(c, rules).alias("passed"),
        )
        for c in df.columns
    ]
    return _counters(df, rules).select(F.inline(F.array(*cells)))


def uniqueness(df: DataFrame, rules: QualityRules = PAYMENT_RULES) -> DataFrame:
    total, distinct = F.col("total_records"), F.col("unique_records")
    return duplicate_totals(df).select(
        total,
        distinct,
        (total - distinct).alias("duplicate_count"),
        _percent(total - distinct, total).alias("duplicate_percentage"),
        _unique(total, distinct, rules).alias("passed"),
    )


def _checks(df: DataFrame, rules: QualityRules, kind: str, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column_name string, invalid_count bigint, passed boolean"
        )
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(kind).getField(c).alias("invalid_count"),
            (F.col(kind).getField(c) == 0).alias("passed"),
        )
        for c in columns
    ]
    return _counters(df, rules).select(F.inline(F.array(*cells)))


def validity(df: DataFrame, rules: QualityRules = PAYMENT_RULES) -> DataFrame:
    return _checks(df, rules, "out_of_range", list(rules.ranges))


def consistency(df: DataFrame, rules: QualityRules = PAYMENT_RULES) -> DataFrame:
    return _checks(df, rules, "disallowed", list(rules.allowed))


def range_violations(df: DataFrame, column: str, bounds: Range) -> DataFrame:
    return df.filter(outside(present(df, column), bounds))


def disallowed_rows(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(not_allowed(named(column), values))


def bad_values(df: DataFrame, rules: QualityRules = PAYMENT_RULES) -> DataFrame:
    """Each disallowed value of each checked column, missing ones included, with its rows."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            named(c).alias("value"),
            not_allowed(named(c), v).alias("bad"),
        )
        for c, v in rules.allowed.items()
    ]
    bad = F.filter(F.array(*cells), lambda cell: cell["bad"])
    return (
        df.select(F.inline(bad))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("invalid_count"))
    )


def _all(tests: Sequence[Column]) -> Column:
    result = F.lit(True)
    for test in tests:
        result = result & test
    return result


def tested(df: DataFrame, rules: QualityRules = PAYMENT_RULES) -> DataFrame:
    """One row: the counters, the duplicate totals and whether each test passed."""
    copies = duplicate_totals(df).select(F.struct("total_records", "unique_records")).scalar()
    return (
        _counters(df, rules)
        .withColumn("copies", copies)
        .withColumns(
            {
                "completeness": _all([_complete(c, rules) for c in df.columns]),
                "uniqueness": _unique(
                    F.col("copies.total_records"), F.col("copies.unique_records"), rules
                ),
                "validity": _all([F.col("out_of_range").getField(c) == 0 for c in rules.ranges]),
                "consistency": _all([F.col("disallowed").getField(c) == 0 for c in rules.allowed]),
            }
        )
    )


# The names of the four tests.
TESTS = ["completeness", "uniqueness", "validity", "consistency"]


def overall(df: DataFrame, rules: QualityRules = PAYMENT_RULES) -> DataFrame:
    passed = sum((F.col(t).cast("int") for t in TESTS), F.lit(0))
    return tested(df, rules).select(
        F.col("rows").alias("total_records"),
        F.when(_all([F.col(t) for t in TESTS]), "PASSED").otherwise("FAILED").alias(
            "overall_status"
        ),
        F.lit(len(TESTS)).alias("total_tests"),
        passed.alias("passed_tests"),
        (F.lit(len(TESTS)) - passed).alias("failed_tests"),
    )
