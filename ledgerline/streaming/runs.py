"""Incremental key summaries over a file-per-run landing folder.

A file source notices the files that arrived since the last call. Each batch folds only
its own rows into partial sums and writes them to a partition of its own, so late files
need no second look at earlier ones and a batch that is retried replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.functions.measures import rounded_mean
from ledgerline.operators.summaries import grouped_key_summaries

BATCH = "batch_id"


def collect_key_summaries(
    spark: SparkSession,
    landing: str,
    partials: str,
    progress: str,
    schema: StructType,
    keys: dict[str, str],
    date: str = "date",
    amount: str = "amount",
) -> None:
    """Fold every file that arrived in the landing folder into the partial sums, then stop."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        folded = grouped_key_summaries(batch, keys, amount, within=[date])
        (
            folded.drop("average_amount")
            .withColumn(BATCH, F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BATCH)
            .parquet(partials)
        )

    query = (
        spark.readStream.schema(schema)
        .json(landing)
        .writeStream.foreachBatch(fold)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def merged_key_summaries(
    partials: DataFrame, by: Sequence[str] = ("date",), digits: int | None = None
) -> DataFrame:
    """The key summaries over all batches, per date or, with no columns, over all dates."""
    totals = partials.groupBy(*by, "summary", "key").agg(
        F.sum("total_amount").alias("total_amount"), F.sum("count").alias("count")
    )
    mean = rounded_mean(F.col("total_amount"), F.col("count"), digits)
    return totals.withColumn("average_amount", mean)
