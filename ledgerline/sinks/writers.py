"""Writers that refuse to overwrite what a frame is reading.

A path names a folder of part files. `single_file` is for result sets only: it funnels
the last stage through one task, so row-level data must be written without it.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _location(path: str) -> tuple[str, str]:
    parsed = urlparse(path)
    return parsed.netloc, "/" + unquote(parsed.path).strip("/")


def covers(target: str, path: str) -> bool:
    """Whether the path is the target or lies below it; a path without a host matches any."""
    (host, folder), (other_host, other) = _location(target), _location(path)
    if host and other_host and host != other_host:
        return False
    return other == folder or other.startswith(folder.rstrip("/") + "/")


def check_target(df: DataFrame, target: str) -> None:
    for source in df.inputFiles():
        if covers(target, source):
            raise ValueError(f"{target} holds the input file {source}; write elsewhere")


def check_distinct(*targets: str) -> None:
    """Raise when one output folder equals or contains another."""
    for i, first in enumerate(targets):
        for j, second in enumerate(targets):
            if i != j and covers(first, second):
                raise ValueError(f"outputs overlap: {first} and {second}")


def _writer(df: DataFrame, target: str, single_file: bool):
    check_target(df, target)
    return (df.coalesce(1) if single_file else df).write.mode("overwrite")


def write_csv(df: DataFrame, target: str, single_file: bool = False) -> None:
    _writer(df, target, single_file).option("header", True).csv(target)


def write_parquet(df: DataFrame, target: str, single_file: bool = False) -> None:
    _writer(df, target, single_file).parquet(target)


def write_json(
    df: DataFrame, target: str, single_file: bool = False, compression: str | None = None
) -> None:
    _writer(df, target, single_file).json(target, compression=compression)


def write_document(df: DataFrame, target: str) -> None:
    """A one-row, one-column frame of text as one file."""
    _writer(df, target, True).text(target)


def write_run(
    df: DataFrame,
    target: str,
    run_date: str,
    kind: str = "csv",
    single_file: bool = False,
    column: str = "processing_date",
) -> None:
    """Write one run below `column=run_date`; other runs in the target stay."""
    part = f"{target.rstrip('/')}/{column}={run_date}"
    check_target(df, part)
    dated = df.drop(column).withColumn(column, F.lit(run_date))
    (
        (dated.coalesce(1) if single_file else dated)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy(column)
        .format(kind)
        .save(target)
    )
