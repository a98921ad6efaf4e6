"""Spark session construction for object-store and local use."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings for what the cluster's own configuration leaves open.
ENGINE_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def object_store_conf(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """S3A settings taken from the usual AWS variables; only those that are set.

    Without explicit keys the S3A default credential chain stays in charge, and
    without an endpoint the public one does.
    """
    env = os.environ if env is None else env
    conf: dict[str, str] = {}
    endpoint = env.get("AWS_ENDPOINT_URL")
    if endpoint:
        conf["spark.hadoop.fs.s3a.endpoint"] = endpoint
        conf["spark.hadoop.fs.s3a.path.style.access"] = "true"
        conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] = str(
            endpoint.startswith("https://")
        ).lower()
    if env.get("AWS_DEFAULT_REGION"):
        conf["spark.hadoop.fs.s3a.endpoint.region"] = env["AWS_DEFAULT_REGION"]
    if env.get("AWS_ACCESS_KEY_ID") and env.get("AWS_SECRET_ACCESS_KEY"):
        conf["spark.hadoop.fs.s3a.access.key"] = env["AWS_ACCESS_KEY_ID"]
        conf["spark.hadoop.fs.s3a.secret.key"] = env["AWS_SECRET_ACCESS_KEY"]
        conf["spark.hadoop.fs.s3a.aws.credentials.provider"] = (
            "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
        )
    return conf


def build_session(
    app_name: str = "ledgerline",
    conf: Mapping[str, str] | None = None,
    env: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session with object-store access, the caller's settings and, where neither these
    nor the cluster say anything, the engine defaults."""
    given = {**object_store_conf(env), **(conf or {})}
    configured = SparkConf()  # what the cluster or the command line set
    active = SparkSession.getActiveSession()
    for key, value in ENGINE_DEFAULTS.items():
        known = active is not None and active.sparkContext.getConf().contains(key)
        if not known and not configured.contains(key):
            given.setdefault(key, value)
    builder = SparkSession.builder.appName(app_name)
    for key, value in given.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint directory, or a
    folder in its warehouse where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


# Folders written inside the open scopes, the innermost last.
_scopes: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the scratch folder and return the frame that reads it back.

    Cuts the lineage in a way that survives lost executors. Its size on disk is then
    known to the planner, which broadcasts it only below autoBroadcastJoinThreshold.
    """
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is materialized inside when it ends; results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
