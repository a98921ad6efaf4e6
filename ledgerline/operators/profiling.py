"""Column statistics, distributions and frame profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import numeric_columns, present, rounded
from ledgerline.functions.quantiles import exact_quantiles

# The quartiles a description and a box plot show.
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def numeric_stats(df: DataFrame, digits: int | None = None) -> DataFrame:
    """One wide row: count, avg, min, max and stddev of each numeric column. A frame
    without numeric columns gives an empty result."""
    columns = numeric_columns(df)
    if not columns:
        return df.limit(0)
    stats = []
    for name in columns:
        c = present(df, name)
        stats += [
            F.count(c).alias(f"{name}_count"),
            rounded(F.avg(c), digits).alias(f"{name}_avg"),
            F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"),
            rounded(F.stddev(c), digits).alias(f"{name}_stddev"),
        ]
    return df.agg(*stats)


def frame_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.current_timestamp().alias("processing_timestamp"),
    )


def profile_range(df: DataFrame, column: str) -> DataFrame:
    """Rows, columns and the first and last value of a column."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min(column).alias("first_value"),
        F.max(column).alias("last_value"),
    ).withColumn("total_columns", F.lit(len(df.columns)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def category_stats(
    df: DataFrame,
    key: str = "category",
    value: str = "value",
    score: str = "score",
    digits: int | None = None,
) -> DataFrame:
    """Mean, deviation and count of one column and mean and deviation of another per key;
    rows without a key are dropped."""
    v, s = present(df, value), present(df, score)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            rounded(F.avg(v), digits).alias(f"{value}_mean"),
            rounded(F.stddev(v), digits).alias(f"{value}_std"),
            F.count(v).alias(f"{value}_count"),
            rounded(F.avg(s), digits).alias(f"{score}_mean"),
            rounded(F.stddev(s), digits).alias(f"{score}_std"),
        )
    )


def summary_metrics(
    df: DataFrame,
    execution_date: str,
    key: str = "category",
    value: str = "value",
    score: str = "score",
    digits: int | None = None,
) -> DataFrame:
    """One row of global figures with the exact interpolated median."""
    v, s = present(df, value), present(df, score)
    median = exact_quantiles(df, value, {"median": 0.5}).select("median").scalar()
    categories = df.select(key).distinct().agg(F.count(key)).scalar()
    totals = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        rounded(F.avg(v), digits).alias("average_value"),
        rounded(F.stddev(v), digits).alias("std_value"),
        rounded(F.avg(s), digits).alias("average_score"),
    )
    return totals.select(
        F.lit(execution_date).alias("execution_date"),
        "total_records",
        "average_value",
        rounded(median, digits).alias("median_value"),
        "std_value",
        "average_score",
        categories.alias("categories"),
    )


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the chosen columns, from one scan."""
    cells = [
        F.struct(F.lit(c).alias("column"), present(df, c).cast("double").alias("value"))
        for c in columns
    ]
    return df.select(F.inline(F.array(*cells)))


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None
) -> DataFrame:
    """Count, mean, std, min, quartiles (interpolated, exact) and max per numeric column. A
    frame without numeric columns gives an empty result."""
    names = list(columns or numeric_columns(df))
    if not names:
        return df.limit(0)
    rows = []
    for name in names:
        c = present(df, name).cast("double")
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(c).alias("count"),
                rounded(F.avg(c), digits).alias("mean"),
                rounded(F.stddev(c), digits).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            )
        )
    moments = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    quartiles = exact_quantiles(_cells(df, names), "value", QUARTILES, ["column"]).select(
        "column", *[rounded(F.col(q), digits).alias(q) for q in QUARTILES]
    )
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", *QUARTILES, "max"
    )


def describe_exact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, min, quartiles (interpolated) and max per numeric column as text, taken in the
    column's own type: whole numbers and decimals of any size lose no digit, their quartiles
    have two more. Columns of one type share a search. A frame without numeric columns gives
    an empty result, a column without values a count of 0."""
    names = list(columns or numeric_columns(df))
    if not names:
        return df.limit(0)
    kinds: dict = {}
    for name in names:
        kinds.setdefault(df.schema[name].dataType, []).append(name)
    parts = []
    for same in kinds.values():
        cells = [F.struct(F.lit(c).alias("column"), present(df, c).alias("value")) for c in same]
        long = df.select(F.inline(F.array(*cells)))
        ends = long.groupBy("column").agg(
            F.count("value").alias("count"),
            F.min("value").cast("string").alias("min"),
            F.max("value").cast("string").alias("max"),
        )
        found = exact_quantiles(long, "value", QUARTILES, ["column"], exact=True)
        texts = [F.col(q).cast("string").alias(q) for q in QUARTILES]
        parts.append(
            ends.join(found.select("column", *texts), "column", "left").select(
                "column", "count", "min", *QUARTILES, "max"
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def box_stats(df: DataFrame, column: str, by: str, digits: int | None = None) -> DataFrame:
    """Min, quartiles and max of a column per key; rows without a key are dropped."""
    known = df.filter(F.col(by).isNotNull())
    value = present(known, column)
    ends = known.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    quartiles = exact_quantiles(known, column, QUARTILES, [by])
    return ends.join(quartiles, by, "left").select(
        by, "min", *[rounded(F.col(q), digits).alias(q) for q in QUARTILES], "max"
    )


def overall_metrics(df: DataFrame, value: str = "value", digits: int | None = None) -> DataFrame:
    v = present(df, value)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        rounded(F.avg(v), digits).alias("average_value"),
        F.max(v).alias("max_value"),
        F.min(v).alias("min_value"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between the extremes; the last bin includes its right
    edge and empty bins are listed. Equal extremes are widened by one half each way."""
    values = df.select(present(df, column).cast("double").alias("value")).filter(
        F.col("value").isNotNull()
    )
    low, high = F.min("value"), F.max("value")
    flat = low == high
    ends = values.agg(
        F.struct(
            F.when(flat, low - 0.5).otherwise(low).alias("low"),
            F.when(flat, high + 0.5).otherwise(high).alias("high"),
        )
    ).scalar()

    def edge(index: Column) -> Column:
        step = (F.col("ends.high") - F.col("ends.low")) / bins
        return F.col("ends.low") + index * step

    span = F.col("ends.high") - F.col("ends.low")
    guess = F.least(
        F.floor((F.col("value") - F.col("ends.low")) * bins / span), F.lit(bins - 1)
    ).cast("int")
    # The product can land on the wrong side of an edge by one ulp; the edges decide.
    exact = (
        F.col("bin")
        - (F.col("value") < edge(F.col("bin"))).cast("int")
        + ((F.col("value") >= edge(F.col("bin") + 1)) & (F.col("bin") < bins - 1)).cast("int")
    )
    counts = (
        values.withColumn("ends", ends)
        .withColumn("bin", guess)
        .groupBy(exact.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    every_bin = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), ends.alias("ends")
    )
    return (
        every_bin.join(counts, "bin", "left")
        .select(
            "bin",
            edge(F.col("bin")).alias("bin_start"),
            edge(F.col("bin") + 1).alias("bin_end"),
            F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
        )
        .orderBy("bin")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are skipped."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), column)
    )


def ingest_metadata(
    df: DataFrame,
    missing_in: Sequence[str] = ("amount", "category"),
    category: str = "category",
) -> DataFrame:
    """Row count, missing values per column and rows per category as (kind, key, value)."""
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(present(df, c).isNull()).alias(f"missing_{c}") for c in missing_in],
    )
    cells = [("total_records", "rows", "rows")]
    cells += [("missing_values", c, f"missing_{c}") for c in missing_in]
    flat = totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("kind"),
                        F.lit(key).alias("key"),
                        F.col(name).alias("value"),
                    )
                    for kind, key, name in cells
                ]
            )
        )
    )
    categories = value_counts(df, category).select(
        F.lit("categories").alias("kind"),
        F.col(category).cast("string").alias("key"),
        F.col("count").alias("value"),
    )
    return flat.unionByName(categories)
