"""Counters that are taken while rows pass by on their way to a sink, without a job of their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.functions.columns import present
from ledgerline.operators.quality import PAYMENT_RULES, QualityRules


@dataclass(frozen=True)
class Counters:
    """What one write saw. Reading any of them waits for that write to end."""

    observation: Observation
    columns: tuple[str, ...]

    @property
    def rows(self) -> int:
        return self.observation.get["rows"]

    @property
    def rejected(self) -> int:
        return self.observation.get["rejected"]

    @property
    def missing(self) -> dict[str, int]:
        """Rows without a value, by column."""
        return {c: self.observation.get[f"missing{i}"] for i, c in enumerate(self.columns)}

    @property
    def total(self) -> float | None:
        return self.observation.get["total"]

    def require_rows(self, what: str) -> Counters:
        """Raise when the write had no rows."""
        if not self.rows:
            raise ValueError(f"no rows in {what}")
        return self


def counted(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    rejected: Column | None = None,
    amount: str | None = None,
) -> tuple[DataFrame, Counters]:
    """The same rows, and counters of those that the next action on them sees: all rows, rows
    that meet `rejected`, rows without a value (null or NaN) for each column, and the sum of
    an amount over the rows that are not rejected. An action that reads only some columns
    still counts all."""
    names = list(df.columns if columns is None else columns)
    refused = F.lit(False) if rejected is None else F.coalesce(rejected, F.lit(False))
    total = F.lit(None).cast("double") if amount is None else present(df, amount).cast("double")
    observation = Observation()
    watched = df.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(refused).alias("rejected"),
        F.sum(F.when(~refused, total)).alias("total"),
        *[F.count_if(present(df, c).isNull()).alias(f"missing{i}") for i, c in enumerate(names)],
    )
    return watched, Counters(observation, tuple(names))


def completeness(
    df: DataFrame, counters: Counters, rules: QualityRules = PAYMENT_RULES
) -> DataFrame:
    """The completeness test from counters alone; the frame only names the session."""
    rows = counters.rows
    percent = {c: n / rows * 100 if rows else 0.0 for c, n in counters.missing.items()}
    lines = [
        (c, n, percent[c], percent[c] <= rules.max_missing * 100)
        for c, n in counters.missing.items()
    ]
    return df.sparkSession.createDataFrame(
        lines, "column_name string, missing_count bigint, missing_percentage double, passed boolean"
    )
