"""Every operator as a query over the star tables of a folder.

Sales come from line items and the tables around them, metrics from line items alone,
payments from events. Faults and gaps are seeded by row position because the tables have
none. Generated rows take their ids from a table, so that their number follows it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ledgerline import schemas
from ledgerline.functions.columns import pick
from ledgerline.operators import cleaning, profiling, quality, rollups, sets, summaries
from ledgerline.plans import jobs
from ledgerline.session import scratch_dir
from ledgerline.sinks import documents, verify, writers
from ledgerline.sources import files, generators, layouts, readers
from ledgerline.sources.readers import read_star_table
from ledgerline.sources.sales import FlatSales, StarSales
from ledgerline.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]

# Parameters that queries and their SQL share.
RUN_DATE = "2024-01-01"
SLICE_DATE = "1999-01-16"
REGION = "ASIA"
SPARSE_FAULTS = 1000
DENSE_FAULTS = 100
ONE_CUSTOMER = 7
BEYOND_DOUBLES = 9007199254740992
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_RULES = quality.QualityRules(
    allowed={"category": EVENT_TYPES, "payment_method": generators.PAYMENT_METHODS}
)

def order_ids(spark: SparkSession, folder: str) -> DataFrame:
    return read_star_table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return read_star_table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("category"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_discount").alias("score"),
    )


def line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return read_star_table(spark, folder, "lineitem").select(
        "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    row = F.col("event_id")
    return read_star_table(spark, folder, "events").select(
        row.alias("id"),
        (F.col("user_id") + 1).alias("customer_id"),
        F.col("ts").alias("transaction_date"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("category"),
        pick(generators.PAYMENT_METHODS, row % 4).alias("payment_method"),
    )


def faulty(spark: SparkSession, folder: str, period: int) -> DataFrame:
    return generators.inject_faults(payments(spark, folder), period=period).drop("id")


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Events with empty rows, missing values and missing types."""
    row = F.col("event_id")

    def kept(column: str, every: int) -> Column:
        return F.when((row % 101 != 0) & (row % every != 0), F.col(column))

    return read_star_table(spark, folder, "events").select(
        F.when(row % 101 != 0, row).alias("event_id"),
        kept("user_id", 71).alias("user_id"),
        kept("event_type", 89).alias("event_type"),
        kept("value", 97).alias("value"),
    )


def _dated(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def _timed(df: DataFrame, column: str = "transaction_date") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def daily_slice(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSales(spark, folder).where("transaction_date", SLICE_DATE)
    return _dated(star.rows(*schemas.SALES.fieldNames()), "transaction_date")


def distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSales(spark, folder)
    columns = ["region", "product_category"]
    found = [
        profiling.distinct_values(star.tally(c), c).select(
            F.lit(c).alias("column_name"), F.col(c).alias("value")
        )
        for c in columns
    ]
    return sets.append_rows(*found)


def _path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def _star_rows(spark: SparkSession, folder: str) -> DataFrame:
    star = StarSales(spark, folder)
    return _dated(star.rows(*schemas.SALES.fieldNames()), "transaction_date")


def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Sales written as JSON lines, read back under the fixed schema, summed."""
    path = _path(spark)
    writers.write_json(_star_rows(spark, folder), path, compression="gzip")
    return summaries.region_summary(readers.read_sales(spark, path))


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same as CSV whose columns have another order and one another name."""
    path = _path(spark)
    made = _star_rows(spark, folder).withColumnRenamed("product_category", "category")
    writers.write_csv(made.select(*reversed(made.columns)), path)
    return summaries.category_summary(readers.read_sales_csv(spark, path))


def csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV and read back without a schema."""
    path = _path(spark)
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    writers.write_csv(read_star_table(spark, folder, "customer").select(*columns), path)
    found = readers.read_csv(spark, path)
    kinds = ", ".join(kind for _, kind in found.dtypes)
    return found.withColumn("kinds", F.lit(kinds))


def dated_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per date from a CSV whose date is text, some of it no date."""
    path = _path(spark)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("soon")).otherwise(day)
    made = read_star_table(spark, folder, "orders").select("o_orderkey", text.alias("day"))
    writers.write_csv(made, path)
    layout = schemas.layout(o_orderkey=LongType(), day=DateType())
    dated = readers.read_dated_csv(spark, path, layout, "day")
    return _dated(dated.groupBy("day").agg(F.count(F.lit(1)).alias("orders")), "day")


def run_slice(spark: SparkSession, folder: str) -> DataFrame:
    """One date of orders from a copy that is partitioned by date; only its folder is read."""
    path = _path(spark)
    orders = read_star_table(spark, folder, "orders")
    dated = orders.withColumn("ds", F.date_format("o_orderdate", "yyyy-MM"))
    dated.repartition("ds").write.partitionBy("ds").parquet(path)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False)
    part = readers.run_slice(back.parquet(path), SLICE_DATE[:7])
    return part.select("o_orderkey", "o_custkey", "o_totalprice")


def null_injection(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the amounts blanked: which rows' amounts are left, per category."""
    made = generators.inject_nulls(payments(spark, folder), "amount", 1, 10, 42)
    blank = F.col("amount").isNull()
    return made.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(blank).alias("blanked"),
        F.sum(F.when(blank, F.col("id"))).alias("blanked_ids"),
    )


def written_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The regional report written as two dated CSV runs, one of them twice, and read back."""
    path = _path(spark)
    report = summaries.region_sales(StarSales(spark, folder))
    for day in (RUN_DATE, SLICE_DATE, RUN_DATE):
        writers.write_run(report, path, day)
    kind = StructType([*report.schema.fields, StructField("processing_date", StringType())])
    return spark.read.option("header", True).schema(kind).csv(path)


def written_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = _path(spark)
    writers.write_parquet(summaries.category_analysis(StarSales(spark, folder)), path)
    return spark.read.parquet(path)


def companion_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Line items cleaned by the clean job, and its statistics file read back."""
    source, data, stats = _path(spark), _path(spark), _path(spark)
    writers.write_csv(line_numbers(spark, folder).select("l_quantity", "l_tax"), source)
    layout = schemas.layout(l_quantity=DoubleType(), l_tax=DoubleType())
    jobs.run_clean_job(spark, source, data, stats, dt.datetime(2024, 1, 1), layout)
    found = spark.read.option("header", True).option("inferSchema", True).csv(stats)
    rounded = [F.round(f"{c}_{n}", 4).alias(f"{c}_{n}")
               for c in ("l_quantity", "l_tax") for n in ("avg", "stddev")]
    return found.select(
        "l_quantity_count", "l_quantity_min", "l_quantity_max", "l_tax_count", "l_tax_min",
        "l_tax_max", *rounded,
    )


def outputs_by_region(spark: SparkSession, folder: str) -> DataFrame:
    """Regions written to a folder each and verified: which of the expected ones exist. What
    is expected comes from the table, and one more is absent."""
    path = _path(spark)
    regions = read_star_table(spark, folder, "region")
    regions.repartition("r_name").write.partitionBy("r_name").parquet(path)
    names = [f"r_name={r[0]}" for r in regions.select("r_name").collect()]  # five
    found = verify.verify_outputs(spark, path, [*names, "r_name=ATLANTIS"])
    return found.select("expected", "exists", (F.col("files") > 0).alias("has_files"))


def impute_bigint(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers beyond what a double holds, with gaps."""
    key = F.col("o_orderkey")
    value = F.when(key % 5 != 0, key + F.lit(BEYOND_DOUBLES))
    made = read_star_table(spark, folder, "orders").select("o_orderkey", value.alias("value"))
    return cleaning.impute_median(made, 0.0)


def impute_decimal(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    big = F.lit("12345678901234567890.12").cast("decimal(30,2)")
    value = F.when(key % 5 != 0, (big + key.cast("decimal(19,0)")).cast("decimal(30,2)"))
    made = read_star_table(spark, folder, "orders").select("o_orderkey", value.alias("value"))
    return cleaning.impute_median(made, 0.0).withColumn("value", F.col("value").cast("string"))


def json_document(spark: SparkSession, folder: str) -> DataFrame:
    """The regional report as JSON lines, one object per key, read back to rows."""
    path = _path(spark)
    report = summaries.region_analysis(StarSales(spark, folder))
    writers.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


def json_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The same with as many keys as there are customers."""
    path = _path(spark)
    report = summaries.customer_totals(StarSales(spark, folder), 2)
    writers.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


def incremental_key_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Sales that land as JSON files, folded by the stream and merged over dates."""
    base = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    landing, partials, progress = f"{base}/landing", f"{base}/partials", f"{base}/progress"
    _star_cat_rows(spark, folder).write.json(landing)
    runs.collect_key_summaries(
        spark, landing, partials, progress, schemas.SIMPLE_SALES_CAT, SIMPLE_KEYS
    )
    return runs.merged_key_summaries(spark.read.parquet(partials), [], 2).withColumn(
        "total_amount", F.round("total_amount", 2)
    )


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Some fields of the validation report, read back from its JSON."""
    report = documents.quality_document(_sparse(spark, folder), RUN_DATE, EVENT_RULES)

    def field(path: str, kind: str) -> Column:
        return F.get_json_object("value", f"$.{path}").cast(kind)

    return report.select(
        field("execution_date", "string").alias("execution_date"),
        field("total_records", "bigint").alias("total_records"),
        field("overall_status", "string").alias("overall_status"),
        field("tests_summary.passed_tests", "int").alias("passed_tests"),
        field("tests.completeness.missing_data.amount", "bigint").alias("missing_amounts"),
        field("tests.uniqueness.unique_records", "bigint").alias("unique_records"),
    )


# Reports that merge what each run left behind

def _run_facts(spark: SparkSession, folder: str) -> rollups.RunFacts:
    path = _path(spark)
    rollups.write_run_facts(
        StarSales(spark, folder), path, F.date_format("transaction_date", "yyyy-MM")
    )
    return rollups.RunFacts.read(spark, path)


def final_counts_over_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The final counts of all months, from what each month's run wrote."""
    return _run_facts(spark, folder).final_counts()


def distinct_over_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct customers and products per year and over all, from the same sets per month."""
    keys = _run_facts(spark, folder).keys
    year = F.substring("run", 1, 4)
    by_year = rollups.distinct_counts(keys.withColumn("period", year), "period")
    over_all = rollups.distinct_counts(keys.withColumn("period", F.lit("all")), "period")
    return (
        by_year.unionByName(over_all)
        .filter(F.col("name").isin("customer_id", "product_id"))
        .select("period", "name", "known")
    )


SKETCHED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]


def quantiles_over_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of line items from sketches per month of shipping, merged; beside each the
    exact one and whether the merged one's rank is within 1 %."""
    lines = read_star_table(spark, folder, "lineitem").select(*SKETCHED, "l_shipdate")
    path = _path(spark)
    month = F.date_format("l_shipdate", "yyyy-MM")
    rollups.value_sketches(lines, month, SKETCHED).write.parquet(path)
    found = rollups.merged_quantiles(spark.read.parquet(path), profiling.QUARTILES)
    near = rollups.ranks_within(lines, found, profiling.QUARTILES, 0.01)
    described = profiling.describe(lines, SKETCHED, 4).select(
        F.col("column").alias("name"),
        F.inline(F.array(*[
            F.struct(F.lit(q).alias("quantile"), F.col(q).alias("exact"))
            for q in profiling.QUARTILES
        ])),
    )
    return near.join(described, ["name", "quantile"]).select(
        "name", "quantile", F.col("values").alias("known"), "exact", "within"
    )


def impute_median_default(spark: SparkSession, folder: str) -> DataFrame:
    """The clean job's own rank error of 1 %: how many values were filled, with how many
    different ones, and whether that one's rank is near the middle."""
    column = "value"
    rows = gappy(spark, folder)
    filled = cleaning.impute_median(rows).select("event_id", F.col(column).alias("filled"))
    # Rows without an id have no value either; all of them get the same one.
    known = rows.filter(F.col(column).isNotNull())
    made = filled.groupBy("filled").agg(F.count(F.lit(1)).alias("n"))
    most = made.agg(F.max_by("filled", "n")).scalar()
    total = known.agg(F.count(F.lit(1))).scalar()
    facts = known.agg(
        F.count_if(F.col(column) < most).alias("below"),
        F.count_if(F.col(column) <= most).alias("upto"),
    ).select(F.struct("*")).scalar()
    gaps = rows.filter(F.col(column).isNull()).agg(F.count(F.lit(1))).scalar()
    near = (facts.getField("below") <= total * 0.51) & (facts.getField("upto") >= total * 0.49)
    return filled.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("filled").isNull()).alias("still_missing"),
        (F.count_if(F.col("filled") == most) >= gaps).alias("one_value"),
    ).withColumns({"gaps": gaps, "near_the_middle": near})


# Runs as files


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """A copy of orders with a folder per month, checked against the months that the table
    has and one that it has not: files, rows, least and greatest key of each in one scan."""
    path = _path(spark)
    orders = read_star_table(spark, folder, "orders")
    dated = orders.withColumn("ds", F.date_format("o_orderdate", "yyyy-MM"))
    dated.repartition("ds").write.partitionBy("ds").parquet(path)
    months = dated.select("ds").distinct()
    absent = orders.agg(
        F.date_format(F.add_months(F.max("o_orderdate").cast("date"), 1), "yyyy-MM").alias("ds")
    )
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False)
    copy = back.parquet(path).withColumn("ds", F.date_format(F.to_date("ds"), "yyyy-MM"))
    held = files.run_contents(
        files.file_contents(copy, "o_orderkey", "ds"), months.unionByName(absent), "ds"
    )
    listed = files.file_inventory(spark, path).select(
        F.regexp_extract("path", "ds=([^/]+)/", 1).alias("ds"), "size"
    ).groupBy("ds").agg(F.sum("size").alias("listed"))
    return held.join(listed, "ds", "left").select(
        F.col("ds").alias("run"), "expected", "exists", "rows", "least", "greatest", "gapless",
        (F.col("total_size") == F.col("listed")).alias("sized"),
    )


def recent_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each year written one after another: the years of the two latest files."""
    path = _path(spark)
    orders = read_star_table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    years = sorted(r.year for r in orders.select("year").distinct().collect())  # a handful
    for year in years:
        writers.write_parquet(
            orders.filter(F.col("year") == year).select("o_orderkey"), f"{path}/{year}", True
        )
    data = files.file_inventory(spark, path).filter(F.col("path").endswith(".parquet"))
    latest = files.recent_files(data, 2)
    return latest.select(F.regexp_extract("path", "/([0-9]+)/[^/]+$", 1).cast("int").alias("year"))


def bad_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The sales job over JSON lines some of which are cut short: what it counted while it
    staged them, the lines that it set apart, and its final counts."""
    source, out, bad = _path(spark), _path(spark), _path(spark)
    made = _star_rows(spark, folder)
    line = F.to_json(F.struct(*made.columns))
    cut = F.col("customer_id") % 40 == 0
    broken = F.concat(F.lit("{"), F.substring_index(line, ",", 2))
    lines = made.select(F.when(cut, broken).otherwise(line).alias("value"))
    lines.write.option("compression", "gzip").text(source)  # some seven times smaller
    seen: list = []
    counts = jobs.run_sales_job(spark, source, out, bad, seen)
    apart = spark.read.text(bad).agg(F.count(F.lit(1))).scalar()
    return counts.select(
        F.lit(seen[0].rows).cast("bigint").alias("lines"),
        F.lit(seen[0].rejected).cast("bigint").alias("rejected"),
        F.lit(seen[0].missing["region"]).cast("bigint").alias("without_region"),
        apart.alias("set_apart"), "total_records", "total_revenue", "unique_customers",
    )


def daily_job(spark: SparkSession, folder: str) -> DataFrame:
    """One run date's CSV through the daily job; its four reports read back from their files."""
    source, out = _path(spark), _path(spark)
    day = daily_slice(spark, folder).select(*schemas.SALES.fieldNames())
    writers.write_csv(day, readers.run_file(source, SLICE_DATE, "csv"))
    jobs.run_daily_job(spark, source, out, SLICE_DATE)

    def report(name: str, key: str, value: str, n: str) -> DataFrame:
        part = f"{out}/{name}/processing_date={SLICE_DATE}"
        found = spark.read.option("header", True).csv(part)
        return found.select(
            F.lit(name).alias("report"), F.col(key).alias("key") if key else F.lit("").alias("key"),
            F.round(F.col(value).cast("double"), 2).alias("revenue"), F.col(n).cast("bigint").alias("n"),
        )

    grouped = sets.append_rows(
        report("sales-by-region", "region", "total_revenue", "order_count"),
        report("sales-by-category", "product_category", "total_revenue", "total_quantity"),
    )
    dated = report("daily-sales", "transaction_date", "daily_revenue", "transaction_count")
    summary = report("summary", "", "total_revenue", "unique_customers")
    return sets.append_rows(sets.append_rows(grouped, dated), summary)


def created_input(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per customer written where there is nothing, then asked for again with another
    example: the first file is reused."""
    path = _path(spark)
    counts = read_star_table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders")
    )
    kind = schemas.layout(o_custkey=LongType(), orders=LongType())
    readers.read_or_create(spark, path, kind, counts)
    return readers.read_or_create(spark, path, kind, counts.filter("orders < 0"))


def bucketed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per customer from a table of daily tallies that is bucketed by customer."""
    table = f"customer_tally_{uuid.uuid4().hex}"
    layouts.write_keyed_tally(StarSales(spark, folder), table, "customer_id", buckets=8)
    return summaries.customer_totals(layouts.keyed_tally(spark, table, "customer_id"), 2)


def lines_of_a_run(spark: SparkSession, folder: str) -> DataFrame:
    """Line items foldered by the month of their order; those of the months in which one
    customer ordered, day by day."""
    path = _path(spark)
    orders = read_star_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )
    lines = read_star_table(spark, folder, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey"), "left"
    )
    kept = lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "day", "month")
    layouts.write_lines_by_run(kept.drop("month"), path, F.substring("day", 1, 7))
    months = orders.filter(F.col("o_custkey") == ONE_CUSTOMER).select(F.col("month").alias("run"))
    return layouts.lines_of(spark, path, months).groupBy("run", "day").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )


def footer_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Number and range of order keys from the footers of a copy of orders in several files."""
    path = _path(spark)
    read_star_table(spark, folder, "orders").repartition(5).write.parquet(path)
    return layouts.footer_profile(spark, path, "o_orderkey")


def guarded_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per status, behind the guard that refuses an input without rows."""
    orders = readers.require_rows(read_star_table(spark, folder, "orders"), "orders")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


def no_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of a table without numbers: an empty result, not an error."""
    return profiling.numeric_stats(read_star_table(spark, folder, "customer").select("c_name"))


def sampled_points(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of the lines' prices and discounts, chosen by the lines' keys."""
    lines = read_star_table(spark, folder, "lineitem").repartition(7, "l_partkey")
    return cleaning.scatter_points(
        lines, "l_extendedprice", "l_discount", 0.05, 42, ["l_orderkey", "l_linenumber"]
    )


def sampled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly five hundred orders, chosen by their keys."""
    orders = read_star_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return cleaning.sample_rows(orders.repartition(5), ["o_orderkey"], 500)


def typed_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf of the validation report, stored as a typed document and read back."""
    path = _path(spark)
    report = documents.quality_report(_sparse(spark, folder), RUN_DATE, EVENT_RULES)
    documents.typed_document(report).write.parquet(path)
    leaves = documents.document_leaves(spark.read.parquet(path))
    number = F.when(F.col("kind").isin("BIGINT", "DOUBLE"), F.col("text").cast("double"))
    return leaves.filter("path <> 'timestamp'").select(
        "path", F.round(number, 6).alias("number"), F.when(number.isNull(), F.col("text")).alias("text")
    )


def describe_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers beyond doubles and decimals, described in their own types."""
    key = F.col("o_orderkey")
    money = (F.lit("12345678901234567890.12").cast("decimal(30,2)") + key.cast("decimal(19,0)"))
    made = read_star_table(spark, folder, "orders").select(
        (key + F.lit(BEYOND_DOUBLES)).alias("whole"), money.cast("decimal(30,2)").alias("money")
    )
    return profiling.describe_exact(made)


def _star(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(StarSales(spark, folder), *args, **kwargs)


def _on(frame: Query, operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(frame(spark, folder), *args, **kwargs)


def _sales_rows(spark: SparkSession, folder: str) -> DataFrame:
    return generators.sales(order_ids(spark, folder), RUN_DATE)


def _simple_rows(spark: SparkSession, folder: str) -> DataFrame:
    return generators.simple_sales(order_ids(spark, folder), RUN_DATE)


def _simple_cat_rows(spark: SparkSession, folder: str) -> DataFrame:
    return generators.simple_sales_cat(order_ids(spark, folder), RUN_DATE)


def _star_cat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Sales as categorised simple ones."""
    return _star_rows(spark, folder).select(
        "transaction_id",
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("total_amount").alias("amount"),
        F.col("transaction_date").alias("date"),
        "region",
        F.col("product_category").alias("category"),
    )


def _sparse(spark: SparkSession, folder: str) -> DataFrame:
    return faulty(spark, folder, SPARSE_FAULTS)


def _dense(spark: SparkSession, folder: str) -> DataFrame:
    return faulty(spark, folder, DENSE_FAULTS)


def _sound(spark: SparkSession, folder: str) -> DataFrame:
    return payments(spark, folder).drop("id")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read_star_table(spark, folder, "events")


# Name of each key summary and the sales column behind it.
KEYS = {"region": "region", "category": "product_category", "customer": "customer_id"}
SIMPLE_KEYS = {"region": "region", "category": "category", "customer": "customer_id"}

QUERIES: dict[str, Query] = {
    # Sources, generators, sinks
    "daily_slice": daily_slice,
    "profile_range": lambda s, d: profiling.profile_range(
        read_star_table(s, d, "orders").withColumn(
            "o_orderdate", F.col("o_orderdate").cast("date").cast("string")
        ),
        "o_orderdate",
    ),
    "distinct_values": distinct_values,
    "json_scan": json_scan,
    "csv_scan": csv_scan,
    "csv_inferred": csv_inferred,
    "dated_csv": dated_csv,
    "run_slice": run_slice,
    "outputs_by_region": outputs_by_region,
    "written_runs": written_runs,
    "written_parquet": written_parquet,
    "companion_stats": companion_stats,
    "null_injection": null_injection,
    "gen_sales": _sales_rows,
    "gen_simple_sales": _simple_rows,
    "gen_simple_sales_cat": _simple_cat_rows,
    "gen_batch_totals": lambda s, d: FlatSales(_sales_rows(s, d)).tally().select(
        F.col("rows").alias("record_count"), F.round("revenue", 2).alias("total_revenue")
    ),
    "fault_injection": lambda s, d: _timed(_sparse(s, d)),
    "json_document": json_document,
    "json_customers": json_customers,
    "run_files": run_files,
    "recent_runs": recent_runs,
    "bad_lines": bad_lines,
    "daily_job": daily_job,
    "created_input": created_input,
    "guarded_orders": guarded_orders,
    "no_numbers": no_numbers,
    "bucketed_customers": bucketed_customers,
    "lines_of_a_run": lines_of_a_run,
    "footer_profile": footer_profile,
    # Projections, filters, cleaning
    "derived_amount": lambda s, d: cleaning.with_line_amount(
        StarSales(s, d).rows("transaction_id", "quantity", "unit_price")
    ),
    "with_constant": lambda s, d: cleaning.with_constant(
        cleaning.preview(read_star_table(s, d, "nation").orderBy("n_nationkey"), 10),
        "run_date",
        RUN_DATE,
    ),
    "first_rows": lambda s, d: sets.append_first(
        read_star_table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 4
    ),
    "region_filter": lambda s, d: _dated(
        StarSales(s, d)
        .where("region", REGION)
        .rows("transaction_id", "customer_id", "region", "transaction_date", "total_amount"),
        "transaction_date",
    ),
    "scatter_points": _on(metrics, cleaning.scatter_points, "value", "score"),
    "add_lineage": lambda s, d: cleaning.add_lineage(
        read_star_table(s, d, "events").select("event_id", "value"), dt.datetime(2024, 1, 1)
    ).select(
        "event_id",
        "value",
        F.date_format("processing_timestamp", "yyyy-MM-dd HH:mm:ss").alias("processing_timestamp"),
        F.col("processing_date").cast("string").alias("processing_date"),
    ),
    "drop_all_null": _on(gappy, cleaning.drop_all_null),
    "impute_median": _on(gappy, cleaning.impute_median, 0.0),
    "impute_median_bigint": impute_bigint,
    "impute_median_decimal": impute_decimal,
    "impute_median_default": impute_median_default,
    "sampled_points": sampled_points,
    "sampled_rows": sampled_rows,
    "fill_unknown": _on(gappy, cleaning.fill_unknown),
    "clean": _on(gappy, cleaning.clean, 0.0),
    # The sales job
    "region_summary": _star(summaries.region_summary),
    "category_summary": _star(summaries.category_summary),
    "top_customers": _star(summaries.top_customers),
    "daily_metrics": lambda s, d: _dated(
        summaries.daily_metrics(StarSales(s, d)), "processing_date"
    ),
    "final_counts": _star(summaries.final_counts),
    "final_counts_over_runs": final_counts_over_runs,
    "distinct_over_runs": distinct_over_runs,
    "quantiles_over_runs": quantiles_over_runs,
    # Numeric profile
    "numeric_stats": _on(line_numbers, profiling.numeric_stats, 4),
    "frame_summary": lambda s, d: profiling.frame_summary(read_star_table(s, d, "lineitem")).drop(
        "processing_timestamp"
    ),
    # Dated aggregates
    "region_sales": _star(summaries.region_sales),
    "category_sales": _star(summaries.category_sales),
    "daily_sales": lambda s, d: _dated(
        summaries.daily_sales(StarSales(s, d)), "transaction_date"
    ),
    "processing_summary": _star(summaries.processing_summary, RUN_DATE, 2),
    # Segment and channel reports
    "region_analysis": _star(summaries.region_analysis),
    "category_analysis": _star(summaries.category_analysis),
    "segment_analysis": _star(summaries.segment_analysis),
    "channel_analysis": _star(summaries.channel_analysis),
    "executive_summary": _star(summaries.executive_summary, RUN_DATE),
    # Simple summary and key summaries
    "region_breakdown": _star(summaries.region_breakdown, 2),
    "customer_totals": _star(summaries.customer_totals, 2),
    "top5_customers": _star(summaries.top5_customers, digits=2),
    "simple_summary": _star(summaries.simple_summary, RUN_DATE, 2),
    "regional_key_summary": _star(summaries.key_summary, "region", 2),
    "category_key_summary": _star(summaries.key_summary, "product_category", 2),
    "customer_key_summary": _star(summaries.key_summary, "customer_id", 2),
    "key_summary_all": _star(
        summaries.key_summaries, KEYS, 2, together=[["customer_id", "region"]]
    ),
    "key_summary_grouping_sets": _on(
        _star_cat_rows, summaries.grouped_key_summaries, SIMPLE_KEYS, digits=2
    ),
    "incremental_key_summary": incremental_key_summary,
    # Metrics
    "category_stats": _on(metrics, profiling.category_stats, digits=4),
    "summary_metrics": _on(metrics, profiling.summary_metrics, RUN_DATE, digits=4),
    "describe_exact": describe_exact,
    "describe": _on(line_numbers, profiling.describe, digits=4),
    "overall_metrics": _on(metrics, profiling.overall_metrics, digits=4),
    "histogram": lambda s, d: profiling.histogram(metrics(s, d), "value").select(
        "bin",
        F.round("bin_start", 4).alias("bin_start"),
        F.round("bin_end", 4).alias("bin_end"),
        "count",
    ),
    "box_stats": _on(metrics, profiling.box_stats, "value", "category", digits=4),
    "value_counts": _on(_events, profiling.value_counts, "event_type"),
    "ingest_metadata": _on(_sparse, profiling.ingest_metadata),
    # Filtered analysis
    "analysis_summary": _star(summaries.analysis_summary, RUN_DATE, REGION, 2),
    "regional_analysis": _star(summaries.regional_analysis),
    "product_analysis": _star(summaries.product_analysis),
    "daily_trend": lambda s, d: _dated(
        summaries.daily_trend(StarSales(s, d), digits=2), "transaction_date"
    ),
    # Data quality
    "dq_completeness": _on(_dense, quality.completeness, EVENT_RULES),
    "dq_uniqueness": _on(_sparse, quality.uniqueness, EVENT_RULES),
    "dq_validity": _on(_sparse, quality.validity, EVENT_RULES),
    "dq_consistency": _on(_sparse, quality.consistency, EVENT_RULES),
    "dq_bad_values": _on(_sparse, quality.bad_values, EVENT_RULES),
    "range_violations": lambda s, d: _timed(
        quality.range_violations(_dense(s, d), "amount", EVENT_RULES.ranges["amount"])
    ),
    "disallowed_rows": lambda s, d: _timed(
        quality.disallowed_rows(_dense(s, d), "category", EVENT_TYPES)
    ),
    "dq_report": quality_report,
    "typed_report": typed_report,
    "dq_overall": _on(_sparse, quality.overall, EVENT_RULES),
    "dq_overall_sound": _on(_sound, quality.overall, EVENT_RULES),
    # Order, sets
    "product_sales_ranked": _star(summaries.ranked_sales, "product_id", digits=2),
    "regional_sales_ranked": _star(summaries.ranked_sales, "region", True, digits=2),
    "last_30_days": lambda s, d: _dated(
        summaries.last_days(StarSales(s, d), digits=2), "transaction_date"
    ),
    "top_region": _star(summaries.top_region),
    "union_all": lambda s, d: sets.append_rows(
        read_star_table(s, d, "customer").select(
            F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
        ),
        read_star_table(s, d, "supplier").select(
            F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
        ),
    ),
    "dedupe": lambda s, d: _timed(sets.dedupe(_dense(s, d))),
}
