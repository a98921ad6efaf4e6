"""Whole jobs: read, check, summarise, write, each with explicit paths.

Every job parses its raw input once. Rows that several summaries share are staged as
Parquet in the scratch folder, then folded once per family of keys. What a job returns is
read back from its output or held by the driver if it is one row, and what it staged is
deleted when it ends.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline import schemas
from ledgerline.functions.columns import named
from ledgerline.operators import cleaning, profiling, quality, summaries
from ledgerline.operators.observed import Counters, counted
from ledgerline.session import materialize, scratch_scope
from ledgerline.sinks import documents, verify, writers
from ledgerline.sources import generators, readers
from ledgerline.sources.sales import FlatSales, fold

# The output folders of the sales job.
SALES_OUTPUTS = {
    "region": "aggregations/region_summary",
    "category": "aggregations/category_summary",
    "customers": "analytics/top_customers",
    "metrics": "metrics/daily_summary",
}


def _guard(raw: DataFrame, base: str, folders: Iterable[str]) -> None:
    """Refuse outputs that would replace the job's own input."""
    for folder in folders:
        writers.check_target(raw, f"{base}/{folder}")


def _held(df: DataFrame) -> DataFrame:
    """A result of one row, held by the driver."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _tidy(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The job, after which what it staged is deleted."""

    @functools.wraps(job)
    def run(first: SparkSession | DataFrame, *args, **kwargs) -> DataFrame:
        spark = first.sparkSession if isinstance(first, DataFrame) else first
        with scratch_scope(spark):
            return job(first, *args, **kwargs)

    return run


def _staged(
    raw: DataFrame, what: str, seen: list[Counters] | None, rejected: Column | None = None
) -> DataFrame:
    """The rows as staged Parquet. Counted while they are written, so that an empty input is
    refused and the caller's list gets the counters without an action of their own."""
    watched, counters = counted(raw, rejected=rejected)
    staged = materialize(watched)
    counters.require_rows(what)
    if seen is not None:
        seen.append(counters)
    return staged


@_tidy
def run_sales_job(
    spark: SparkSession,
    input_path: str,
    output_base: str,
    quarantine: str | None = None,
    seen: list[Counters] | None = None,
) -> DataFrame:
    """JSON sales in, four Parquet summaries out; returns the final counts. With a folder
    for quarantine, lines that do not parse go there as text and are no sales. A list for
    `seen` gets the counters of the input: rows, rejected lines, missing values by column."""
    base = output_base.rstrip("/")
    raw = readers.read_json(spark, input_path, schemas.SALES, quarantine is not None)
    _guard(raw, base, SALES_OUTPUTS.values())
    if quarantine is None:
        rows = _staged(raw, input_path, seen)
    else:
        writers.check_target(raw, quarantine)
        bad = F.col(readers.CORRUPT).isNotNull()
        parsed = _staged(raw, input_path, seen, bad)
        rows = parsed.filter(~bad).drop(readers.CORRUPT)
        parsed.filter(bad).select(readers.CORRUPT).write.mode("overwrite").text(quarantine)
    sales = fold(
        rows, ("customer_id", "region"), ("product_id", "product_category"), ("transaction_date",)
    )
    results = {
        "region": summaries.region_summary(sales),
        "category": summaries.category_summary(sales),
        "customers": summaries.top_customers(sales),
        "metrics": summaries.daily_metrics(sales),
    }
    for name, folder in SALES_OUTPUTS.items():
        writers.write_parquet(results[name], f"{base}/{folder}")
    return _held(summaries.final_counts(sales))


def verify_sales_job(spark: SparkSession, output_base: str) -> DataFrame:
    return verify.verify_outputs(spark, output_base, list(SALES_OUTPUTS.values()))


@_tidy
def run_clean_job(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    stats_path: str,
    run_time: dt.datetime | None = None,
    schema: StructType | None = None,
    seen: list[Counters] | None = None,
) -> DataFrame:
    """CSV in, cleaned CSV with lineage columns and a statistics CSV out; returns the
    frame summary. The two outputs must not overlap. A schema saves the inference pass. An
    empty input raises; a list for `seen` gets the counters of the input, whose `rejected`
    are the rows without any value, which cleaning drops."""
    writers.check_distinct(output_path, stats_path)
    raw = readers.read_csv(spark, input_path, schema)
    writers.check_target(raw, output_path)
    writers.check_target(raw, stats_path)
    empty = F.coalesce(*[named(c).cast("string") for c in raw.columns]).isNull()
    rows = _staged(raw, input_path, seen, empty)
    cleaned = materialize(cleaning.add_lineage(cleaning.clean(rows), run_time))
    writers.write_csv(cleaned, output_path)
    writers.write_csv(profiling.numeric_stats(cleaned), stats_path)
    return _held(profiling.frame_summary(cleaned))


# The output folders of the daily job.
DAILY_OUTPUTS = ["sales-by-region", "sales-by-category", "daily-sales", "summary"]


@_tidy
def run_daily_job(
    spark: SparkSession, input_folder: str, output_base: str, run_date: str
) -> DataFrame:
    """One run date's CSV in; region, category, daily and summary CSVs out under the date."""
    base = output_base.rstrip("/")
    path = readers.run_file(input_folder, run_date, "csv")
    raw = readers.read_csv(spark, path, schemas.SALES)
    _guard(raw, base, DAILY_OUTPUTS)
    sales = fold(
        materialize(readers.require_rows(raw, path)),
        ("customer_id", "region"),
        ("product_id", "product_category"),
        ("transaction_date",),
    )
    summary = summaries.processing_summary(sales, run_date)
    results = [
        summaries.region_sales(sales),
        summaries.category_sales(sales),
        summaries.daily_sales(sales),
        summary,
    ]
    for folder, result in zip(DAILY_OUTPUTS, results, strict=True):
        writers.write_run(result, f"{base}/{folder}", run_date)
    return _held(summary)


# The output folders of the channel job.
CHANNEL_OUTPUTS = [
    "region-analysis", "category-analysis", "segment-analysis", "channel-analysis",
    "executive-summary",
]


@_tidy
def run_channel_job(
    spark: SparkSession, input_folder: str, output_base: str, run_date: str
) -> DataFrame:
    """One run date's JSON in; four reports as JSON lines, one object per key, and the
    executive summary as a document out."""
    base = output_base.rstrip("/")
    path = readers.run_file(input_folder, run_date)
    raw = readers.read_json(spark, path, schemas.SALES_EXT)
    _guard(raw, base, [f"{folder}/{run_date}" for folder in CHANNEL_OUTPUTS])
    sales = fold(
        materialize(readers.require_rows(raw, path)),
        ("customer_id", "region", "customer_segment", "sales_channel"),
        ("product_id", "product_category"),
    )
    summary = summaries.executive_summary(sales, run_date)
    results = [
        summaries.region_analysis(sales),
        summaries.category_analysis(sales),
        summaries.segment_analysis(sales),
        summaries.channel_analysis(sales),
    ]
    for folder, result in zip(CHANNEL_OUTPUTS, results, strict=False):
        writers.write_json(result, f"{base}/{folder}/{run_date}")
    document = documents.row_document(summary)
    writers.write_document(document, f"{base}/{CHANNEL_OUTPUTS[-1]}/{run_date}")
    return _held(summary)


@_tidy
def run_simple_job(
    spark: SparkSession, input_folder: str, output_base: str, run_date: str
) -> DataFrame:
    """One run date's simple sales in, the simple summary as JSON lines (kind, key, value)
    out; returns it as written."""
    path = readers.run_file(input_folder, run_date)
    raw = readers.read_json(spark, path, schemas.SIMPLE_SALES)
    target = f"{output_base.rstrip('/')}/simple-summary/{run_date}"
    writers.check_target(raw, target)
    readers.require_rows(raw, path)
    sales = fold(FlatSales(raw, amount="amount"), ("customer_id", "region"))
    summary = summaries.simple_summary(sales, run_date)
    writers.write_json(summary, target)
    return spark.read.schema(summary.schema).json(target)


# Output folder and key of each summary of the key summary job.
KEY_OUTPUTS = {
    "regional-summary": "region",
    "category-summary": "category",
    "customer-summary": "customer_id",
}


@_tidy
def run_key_summary_job(
    spark: SparkSession, input_folder: str, output_base: str, run_date: str
) -> DataFrame:
    """One run date's categorised sales in; JSON lines per key out. The three summaries
    come from one pass over the input and are split by folder when written."""
    base = output_base.rstrip("/")
    path = readers.run_file(input_folder, run_date)
    raw = readers.read_json(spark, path, schemas.SIMPLE_SALES_CAT)
    _guard(raw, base, [f"{name}/{run_date}" for name in KEY_OUTPUTS])
    readers.require_rows(raw, path)
    summary = materialize(summaries.grouped_key_summaries(raw, KEY_OUTPUTS))
    for name in KEY_OUTPUTS:
        part = summary.filter(F.col("summary") == name).drop("summary")
        writers.write_json(part, f"{base}/{name}/{run_date}")
    kind = summary.drop("summary").schema
    written = [
        spark.read.schema(kind).json(f"{base}/{name}/{run_date}").select(F.lit(name).alias("summary"), "*")
        for name in KEY_OUTPUTS
    ]
    return functools.reduce(DataFrame.unionByName, written)


@_tidy
def run_quality_job(
    df: DataFrame,
    output_base: str,
    execution_date: str,
    rules: quality.QualityRules = quality.PAYMENT_RULES,
) -> DataFrame:
    """Validate a frame and write the report document under its date; returns it."""
    target = f"{output_base.rstrip('/')}/{execution_date}"
    writers.check_target(df, target)
    rows = materialize(df)
    document = _held(documents.quality_document(rows, execution_date, rules))
    writers.write_document(document, target)
    return document


@_tidy
def run_ingest_job(
    spark: SparkSession, output_base: str, execution_date: str, rows: int = 10_000, seed: int = 42
) -> DataFrame:
    """Generate payments with missing values, write them as CSV and return their metadata as
    rows, read from what was written."""
    made = generators.payments(generators.row_ids(spark, rows), execution_date, seed)
    made = generators.inject_nulls(made, "amount", rows // 100, rows, seed)
    made = generators.inject_nulls(made, "category", rows // 200, rows, seed)
    target = f"{output_base.rstrip('/')}/{execution_date}"
    writers.write_csv(made.drop("id"), target)
    written = readers.read_csv(spark, target, schemas.PAYMENTS)
    return profiling.ingest_metadata(written)


@_tidy
def run_analysis_job(
    spark: SparkSession,
    input_path: str,
    output_base: str,
    analysis_date: str,
    region: str = "all",
) -> DataFrame:
    """Demo sales CSV in (created when absent); summary, regional and product CSVs out."""
    base = output_base.rstrip("/")
    example = generators.demo_sales(
        generators.date_range(spark, "2025-01-01", "2025-07-24")
    ).select(*schemas.DEMO_SALES.fieldNames())
    readers.read_or_create(spark, input_path, schemas.DEMO_SALES, example)
    rows = readers.read_dated_csv(spark, input_path, schemas.DEMO_SALES, "date")
    outputs = ["analysis_summary", "regional_analysis", "product_analysis", "daily_trend"]
    _guard(rows, base, outputs)
    sales = fold(
        FlatSales(materialize(rows), amount="sales_amount"),
        ("customer_id", "region"),
        ("product", "region"),
        ("date", "region"),
    )
    summary = summaries.analysis_summary(sales, analysis_date, region)
    results = [
        summary,
        summaries.regional_analysis(sales, region),
        summaries.product_analysis(sales, region, "product"),
        summaries.daily_trend(sales, region, "date"),
    ]
    for folder, result in zip(outputs, results, strict=True):
        writers.write_run(result, f"{base}/{folder}", analysis_date, column="run_date")
    return _held(summary)


@_tidy
def run_metrics_job(df: DataFrame, output_base: str, execution_date: str) -> DataFrame:
    """Profile metrics: description, per-category figures, distribution and summary CSVs."""
    base = output_base.rstrip("/")
    df = materialize(df)
    summary = _held(profiling.summary_metrics(df, execution_date))
    results = {
        "describe": profiling.describe(df, ["value", "score"]),
        "category_stats": profiling.category_stats(df),
        "box_stats": profiling.box_stats(df, "value", "category"),
        "histogram": profiling.histogram(df, "value"),
        "value_counts": profiling.value_counts(df, "category"),
        "summary_metrics": summary,
    }
    for folder, result in results.items():
        writers.write_run(result, f"{base}/{folder}", execution_date, column="run_date")
    return summary
