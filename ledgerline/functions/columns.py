"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def named(name: str) -> Column:
    """The top-level column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing; other types pass through unchanged."""
    column = named(name)
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({name: present(df, name) for name in floats}) if floats else df


def rounded(column: Column, digits: int | None) -> Column:
    return column if digits is None else F.round(column, digits)


def pick(values: Sequence[str], index: Column) -> Column:
    """The index-th (0-based) entry of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lot(keys: Sequence[str], seed: int, stream: str = "") -> Column:
    """A whole number from 0 to 2**32 - 1 that depends on the seed, the stream and the text of
    the row's keys alone (null as empty), by MD5: any engine can draw it again."""
    parts = [F.coalesce(named(k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(f"{seed}{stream}"), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(identifier: Column, seed: int, stream: str) -> Column:
    """A pseudo-random double in [0, 1) that depends only on the row's id.

    Unlike rand(), a retried or repartitioned task draws the same number again.
    """
    mixed = F.xxhash64(F.xxhash64(identifier, F.lit(seed)), F.lit(stream))
    return F.shiftrightunsigned(mixed, 11).cast("double") * F.lit(2.0**-53)


def uniform_int(identifier: Column, seed: int, stream: str, low: int, high: int) -> Column:
    """A whole number in [low, high], both ends included."""
    return (F.floor(uniform(identifier, seed, stream) * (high - low + 1)) + low).cast("int")


def normal(identifier: Column, seed: int, stream: str, mean: float, std: float) -> Column:
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(identifier, seed, stream + ":r")))
    angle = 2.0 * math.pi * uniform(identifier, seed, stream + ":a")
    return radius * F.cos(angle) * std + mean
