"""Check that a run produced the files it should have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.files import file_inventory


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as listings spell it: with its scheme, from the root."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(place).toString().rstrip("/")


def verify_outputs(spark: SparkSession, base: str, expected: Sequence[str]) -> DataFrame:
    """For each expected file or folder below the base: whether it exists, its number of
    files, their total size and the latest change. A missing base means nothing exists."""
    names = [(e, e.strip("/")) for e in dict.fromkeys(expected)]
    wanted = spark.createDataFrame(names, "expected string, name string")
    try:
        files = file_inventory(spark, base)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, size bigint, last_modified timestamp")
    folder = _qualified(spark, base) + "/"
    below = files.filter(F.col("path").startswith(folder)).withColumn(
        "steps", F.split(F.col("path").substr(F.lit(len(folder) + 1), F.length("path")), "/")
    )
    # A file belongs to itself and to each folder above it, up to the base.
    held = below.select(
        "size",
        "last_modified",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("steps")),
                lambda n: F.array_join(F.slice("steps", 1, n), "/"),
            )
        ).alias("name"),
    )
    found = (
        held.join(wanted.select("name").distinct(), "name", "left_semi")
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("size").alias("total_size"),
            F.max("last_modified").alias("last_modified"),
        )
    )
    return wanted.join(found, "name", "left").select(
        "expected",
        F.col("files").isNotNull().alias("exists"),
        F.coalesce("files", F.lit(0).cast("bigint")).alias("files"),
        F.coalesce("total_size", F.lit(0).cast("bigint")).alias("total_size"),
        "last_modified",
    )


def missing_outputs(verified: DataFrame) -> DataFrame:
    return verified.filter(~F.col("exists")).select("expected")
