"""Exact quantiles that never gather a group in one task.

A first round counts rows per group and leading bits of an order-preserving code, combined on
the map side (at most 2**16 counters a group), and finds the counter that holds each wanted
rank. A counter whose least and greatest value are equal is the answer. The others are split
evenly between their own least and greatest value, as often as it takes: the two ends always
fall into counters of their own, so every round narrows, whatever the scale of the values.
A wanted rank costs a few narrow scans and no shuffle of the values. Values keep their type;
doubles only choose the counter.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType

from ledgerline.functions.columns import named, present
from ledgerline.session import materialize

PARTS = 1 << 16
STATE = ["group", "rank", "total", "prefix", "below", "inside", "least", "most"]


def order_code(value: Column) -> Column:
    """A number below 2**16 that never decreases as the value grows; close values share one."""
    number = value.cast("double")
    magnitude = F.signum(number) * F.log1p(F.abs(number)) / math.log(2.0)
    clamped = F.greatest(F.least(magnitude, F.lit(1024.0)), F.lit(-1024.0))
    return F.floor((clamped + 1024.0) * (PARTS / 2049)).cast("int")


def split_code(value: Column, least: Column, most: Column, kind: DataType) -> Column:
    """The same between two values: 0 for the least alone, PARTS for the greatest alone."""
    if isinstance(kind, (DoubleType, FloatType)):
        # Halves, so that no difference overflows.
        part, whole = value / 2 - least / 2, most / 2 - least / 2
    else:
        exact = kind if isinstance(kind, DecimalType) else DecimalType(38, 0)
        part, whole = (x.cast(exact) - least.cast(exact) for x in (value, most))
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    # Without a share, next to an infinite end, everything between the ends stays together.
    share = F.when(share.between(0.0, 1.0), share).otherwise(0.0)
    inner = F.least(F.floor(share * (PARTS - 1)) + 1, F.lit(PARTS - 1)).cast("int")
    return F.when(value == least, 0).when(value == most, PARTS).otherwise(inner)


def _ranks(total: Column, probabilities: Sequence[float], interpolate: bool) -> Column:
    """0-based ranks needed for the probabilities, as a duplicate-free array."""
    wanted = []
    for p in probabilities:
        if interpolate:
            position = F.lit(p) * (total - 1)
            wanted += [F.floor(position), F.ceil(position)]
        else:
            wanted.append(F.greatest(F.ceil(F.lit(p) * total) - 1, F.lit(0)))
    return F.array_distinct(F.array(*[w.cast("bigint") for w in wanted]))


def _holding(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The counters whose run of ranks, starting after `below`, covers the wanted rank."""
    window = Window.partitionBy(*keys).orderBy(order)
    return (
        counts.withColumn("upto", F.col("below") + F.sum("inside").over(window))
        .withColumn("below", F.col("upto") - F.col("inside"))
        .filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        .drop("upto")
    )


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Mapping[str, float],
    keys: Sequence[str] = (),
    interpolate: bool = True,
    exact: bool = False,
) -> DataFrame:
    """One row per key combination with a column per named probability.

    Nulls and NaN are skipped. With interpolate the result is a double between the two
    nearest values (the usual linear rule), or with `exact`, for whole numbers and decimals, a
    decimal with two more digits (the share between the values is rounded to hundredths);
    without, it is the lowest value whose share of the rows reaches the probability, in the
    column's type. A group without values gets no row. Runs a job per round when called.
    """
    kind = df.schema[column].dataType
    group = F.struct(*[named(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    values = (
        df.select(group.alias("group"), present(df, column).alias("value"))
        .filter(F.col("value").isNotNull())
        .withColumn("prefix", order_code(F.col("value")))
    )
    counters = [
        F.count(F.lit(1)).alias("inside"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    ]
    by_group = Window.partitionBy("group")
    first = (
        values.groupBy("group", "prefix")
        .agg(*counters)
        .withColumn("total", F.sum("inside").over(by_group))
        .withColumn("below", F.sum("inside").over(by_group.orderBy("prefix")) - F.col("inside"))
        .withColumn("ranks", _ranks(F.col("total"), list(probabilities.values()), interpolate))
        .withColumn("rank", F.explode("ranks"))
        .filter(
            (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))
        )
        .select(*STATE)
    )
    state = materialize(first)
    open_ = F.col("least") < F.col("most")
    while not state.filter(open_).isEmpty():
        holders = state.filter(open_).select("group", "rank", "total", "prefix", "below", "least", "most")
        inside = values.join(holders, ["group", "prefix"]).filter(
            F.col("value").between(F.col("least"), F.col("most"))
        )
        part = split_code(F.col("value"), F.col("least"), F.col("most"), kind)
        target = ["group", "rank", "total", "prefix", "below"]
        counts = inside.groupBy(*target, part.alias("part")).agg(*counters)
        narrowed = _holding(counts, ["group", "rank"], "part").select(*STATE)
        state = materialize(narrowed.unionByName(state.filter(~open_)))

    # At most two ranks per probability, so the map has a fixed bound.
    at = state.groupBy("group").agg(
        F.max("total").alias("total"),
        F.map_from_entries(
            F.collect_list(F.struct("rank", F.col("least").alias("value")))
        ).alias("at"),
    )

    def value_at(rank: Column) -> Column:
        return F.element_at("at", rank.cast("bigint"))

    def quantile(p: float) -> Column:
        if not interpolate:
            return value_at(F.greatest(F.ceil(F.lit(p) * F.col("total")) - 1, F.lit(0)))
        position = F.lit(p) * (F.col("total") - 1)
        if exact and isinstance(kind, (IntegralType, DecimalType)):
            digits = kind.scale if isinstance(kind, DecimalType) else 0
            whole = DecimalType(34, digits)
            lower, upper = (value_at(f(position)).cast(whole) for f in (F.floor, F.ceil))
            share = (position - F.floor(position)).cast("decimal(3,2)")
            return (lower + (upper - lower) * share).cast(DecimalType(38, digits + 2))
        lower, upper = (value_at(f(position)).cast("double") for f in (F.floor, F.ceil))
        # Equal neighbours are the answer themselves, infinite ones included.
        between = lower + (upper - lower) * (position - F.floor(position))
        return F.when(lower == upper, lower).otherwise(between)

    return at.select(
        *[F.col("group").getField(k).alias(k) for k in keys],
        *[quantile(p).alias(name) for name, p in probabilities.items()],
    )
