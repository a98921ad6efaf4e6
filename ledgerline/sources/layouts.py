"""Stored layouts that let a report read less: tables bucketed by key, lines foldered by run,
and what Parquet footers already know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.measures import merge
from ledgerline.sources.sales import FoldedSales, Sales

# Tallies bucketed by key


def write_keyed_tally(
    sales: Sales, table: str, key: str, run: str = "transaction_date", buckets: int = 64
) -> None:
    """Store the measures per run and key as a table that is bucketed and sorted by key.

    Rows are folded first, so a key has one row per run, whatever its share of the sales, and
    no bucket can be filled by one of them. The number of buckets is the number of tasks of
    every report on the table; a report by this key needs no shuffle.
    """
    (
        sales.tally(run, key)
        .repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )


def keyed_tally(spark: SparkSession, table: str, key: str, *more: str) -> FoldedSales:
    """The table as sales that are folded by key: all runs of a key are added up where its
    bucket is read."""
    return FoldedSales({(key, *more): merge(spark.table(table), [key, *more])})


# Lines in a folder per run


def write_lines_by_run(lines: DataFrame, path: str, run: Column) -> None:
    """Lines in a folder per run (column `run`); lines without one go to a folder of their own.
    A run's lines are spread over tasks by their other columns."""
    dated = lines.withColumn("run", run)
    spread = F.pmod(F.xxhash64(*lines.columns), F.lit(4))
    dated.repartition("run", spread).write.mode("overwrite").partitionBy("run").parquet(path)


def lines_of(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """The lines of the runs that a frame names in its column `run` (repeats do not matter).
    Which they are is known only when the frame has been computed; folders of other runs
    are left out by dynamic pruning wherever the frame is filtered."""
    return spark.read.schema(_with_text_run(spark, path)).parquet(path).join(
        runs.select("run").distinct(), "run", "left_semi"
    )


def _with_text_run(spark: SparkSession, path: str):
    schema = spark.read.parquet(path).drop("run").schema
    return schema.add("run", "string")


# Facts from footers


def footer_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster that answers count, min and max of Parquet columns from
    file footers. Settings of the given session stay as they are."""
    own = spark.newSession()
    kept = [s for s in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(kept))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def footer_profile(spark: SparkSession, path: str, column: str) -> DataFrame:
    """total_rows, first_value, last_value of a whole-number, boolean, date or floating column,
    from the footers of the files alone; no row group is read. A filter would read them.
    Floating columns must hold no NaN, which footers do not count."""
    table = footer_session(spark).read.parquet(path)
    return table.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min(column).alias("first_value"),
        F.max(column).alias("last_value"),
    )
