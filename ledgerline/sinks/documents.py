"""Nested JSON documents with a fixed set of keys, as one-row frames with a `value` column.

A report with a row per key is written as JSON lines instead (writers.write_json), one
object per key from as many tasks as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.quality import (
    PAYMENT_RULES,
    TESTS,
    QualityRules,
    tested,
)

def row_document(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def typed_document(df: DataFrame) -> DataFrame:
    """Each row as one typed document (VARIANT): numbers, flags, texts and times keep their
    types, also when it is stored as Parquet."""
    return df.select(F.to_variant_object(F.struct("*")).alias("value"))


def document_leaves(documents: DataFrame, depth: int = 8) -> DataFrame:
    """path, kind, text of every leaf of the documents in column `value`: names and places are
    joined by dots, `kind` is the leaf's type. Nesting deeper than `depth` raises."""
    spark = documents.sparkSession
    level = documents.select(F.lit("").alias("path"), "value")
    found = None
    for _ in range(depth):
        kind = F.schema_of_variant("value")
        nested = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
        leaves = level.filter(~nested).select(
            "path", kind.alias("kind"), F.variant_get("value", "$", "string").alias("text")
        )
        found = leaves if found is None else found.unionByName(leaves)
        level = spark.sql(
            """select concat_ws('.', nullif(path, ''), coalesce(held.key, cast(held.pos as string)))
                 as path, held.value as value
               from {nested} as holder, lateral variant_explode(holder.value) as held""",
            nested=level.filter(nested),
        )
    deeper = F.raise_error(F.concat(F.lit(f"nested deeper than {depth}: "), F.col("path")))
    return found.unionByName(
        level.select("path", F.lit("").alias("kind"), deeper.cast("string").alias("text"))
    )


def quality_document(
    df: DataFrame, execution_date: str, rules: QualityRules = PAYMENT_RULES
) -> DataFrame:
    """The whole validation report as JSON."""
    return row_document(quality_report(df, execution_date, rules))


def quality_report(
    df: DataFrame, execution_date: str, rules: QualityRules = PAYMENT_RULES
) -> DataFrame:
    """The whole validation report as one nested row: every test with its details, and the
    verdict."""

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100

    def checks(kind: str, columns) -> Column:
        details = [
            F.struct(
                (F.col(kind).getField(c) == 0).alias("passed"),
                F.col(kind).getField(c).alias("invalid_count"),
            ).alias(rules.names.get(c, c))
            for c in columns
        ]
        return F.struct(*details) if details else F.lit(None).cast("string")

    total, distinct = F.col("copies.total_records"), F.col("copies.unique_records")
    percentages = [share(F.col("missing").getField(c), F.col("rows")).alias(c) for c in df.columns]
    passed = sum((F.col(t).cast("int") for t in TESTS), F.lit(0))
    tests = F.struct(
        F.struct(
            F.col("completeness").alias("passed"),
            F.col("missing").alias("missing_data"),
            F.struct(*percentages).alias("missing_percentage"),
        ).alias("completeness"),
        F.struct(
            F.col("uniqueness").alias("passed"),
            total.alias("total_records"),
            distinct.alias("unique_records"),
            (total - distinct).alias("duplicate_count"),
            share(total - distinct, total).alias("duplicate_percentage"),
        ).alias("uniqueness"),
        F.struct(
            F.col("validity").alias("passed"), checks("out_of_range", rules.ranges).alias("details")
        ).alias("validity"),
        F.struct(
            F.col("consistency").alias("passed"), checks("disallowed", rules.allowed).alias("details")
        ).alias("consistency"),
    )
    return (
        tested(df, rules).select(
            F.lit(execution_date).alias("execution_date"),
            F.current_timestamp().alias("timestamp"),
            F.col("rows").alias("total_records"),
            tests.alias("tests"),
            F.when(passed == len(TESTS), "PASSED").otherwise("FAILED").alias("overall_status"),
            F.struct(
                F.lit(len(TESTS)).alias("total_tests"),
                passed.alias("passed_tests"),
                (F.lit(len(TESTS)) - passed).alias("failed_tests"),
            ).alias("tests_summary"),
        )
    )
