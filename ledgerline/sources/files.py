"""File listings as DataFrames. Only metadata is read, never file contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import present


def file_inventory(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, size and last_modified of every file at or below the paths."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load([paths] if isinstance(paths, str) else list(paths))
    )
    return listing.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("path").alias("total_objects"),
        F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("total_size"),
    )


def recent_files(files: DataFrame, k: int = 10) -> DataFrame:
    return files.orderBy(F.col("last_modified").desc(), F.col("path")).limit(k)


def first_files(files: DataFrame, k: int = 10) -> DataFrame:
    return files.orderBy("path").limit(k)


def file_contents(df: DataFrame, key: str, *by: str) -> DataFrame:
    """`by` columns, path, size, last_modified, rows, least, greatest and gapless of each file
    that a frame reads: what it holds and what the store says of it, from one scan.

    `least` and `greatest` are of the key (NaN and null left out). `gapless` says that the rows
    seen are the file's first ones without one left out (rows after the last one seen do not
    show); it is null for formats without row numbers. `by` are columns that are the same in
    a whole file, such as those of its folder. A file without rows is not seen: compare with
    file_inventory. `df` must come from a file source unchanged, but for filters.
    """
    meta = F.col("_metadata")
    numbered = "row_index" in df.select("_metadata").schema["_metadata"].dataType.fieldNames()
    last = F.max(meta.getField("row_index")) + 1 if numbered else F.lit(None).cast("bigint")
    value = present(df, key)
    return (
        df.groupBy(
            *by,
            meta.getField("file_path").alias("path"),
            meta.getField("file_size").alias("size"),
            meta.getField("file_modification_time").alias("last_modified"),
        )
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(value).alias("least"),
            F.max(value).alias("greatest"),
            (last == F.count(F.lit(1))).alias("gapless"),
        )
    )


def run_contents(files: DataFrame, expected: DataFrame, run: str) -> DataFrame:
    """For each expected run (rows of `expected`): whether it exists, its files, rows, bytes, least
    and greatest key, latest change and whether rows were left out between others; from
    file_contents by the run's column. Runs that are there but not expected are marked."""
    found = files.groupBy(run).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("rows").alias("rows"),
        F.sum("size").alias("total_size"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.max("last_modified").alias("last_modified"),
        F.every("gapless").alias("gapless"),
    )
    wanted = expected.select(run).distinct().withColumn("wanted", F.lit(True))
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("files", "rows", "total_size")]
    return wanted.join(found, run, "full").select(
        run, F.coalesce("wanted", F.lit(False)).alias("expected"),
        F.col("files").isNotNull().alias("exists"),
        *numbers, "least", "greatest", "last_modified", "gapless",
    )
