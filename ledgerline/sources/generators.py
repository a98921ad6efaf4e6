"""Fixture rows computed from row ids.

Each generator maps a frame with a bigint column `id` to records, so it runs on
spark.range(n) as well as on the ids of any table, and a row depends on its id alone.
Formats, cycle lengths, prices and ranges are fixed values of the fixtures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.columns import lot, normal, pick, uniform, uniform_int

# The categories, regions and channels of the fixtures.
REGIONS = ["North", "South", "East", "West"]
WORLD_REGIONS = ["North America", "Europe", "Asia Pacific", "Latin America", "Africa"]
CATEGORIES = ["Electronics", "Clothing", "Books", "Home", "Sports"]
SIMPLE_CATEGORIES = ["Electronics", "Clothing", "Food", "Books"]
EXT_CATEGORIES = [
    "Electronics", "Clothing", "Books", "Home & Garden",
    "Sports", "Automotive", "Health", "Beauty",
]
SEGMENTS = ["Premium", "Standard", "Economy"]
CHANNELS = ["Online", "Retail Store", "Mobile App", "Phone"]
PAYMENT_CATEGORIES = ["Electronics", "Clothing", "Food", "Books", "Other"]
PAYMENT_METHODS = ["Credit Card", "Debit Card", "Cash", "PayPal"]
PRODUCTS = ["Product_A", "Product_B", "Product_C", "Product_D", "Product_E"]
METRIC_CATEGORIES = ["A", "B", "C", "D"]


def row_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def line_amount() -> Column:
    return F.round(F.col("quantity") * F.col("unit_price"), 2)


def sales(ids: DataFrame, run_date: str) -> DataFrame:
    """Modular sales: every field cycles with the id."""
    i = F.col("id")
    return ids.select(
        F.format_string("TXN_%05d", i).alias("transaction_id"),
        F.format_string("CUST_%03d", i % 100).alias("customer_id"),
        F.format_string("PROD_%03d", i % 50).alias("product_id"),
        (i % 10 + 1).cast("int").alias("quantity"),
        (F.lit(10.0) + (i * F.lit(0.5)) % 100).alias("unit_price"),
        F.lit(run_date).alias("transaction_date"),
        pick(REGIONS, i % 4).alias("region"),
        pick(CATEGORIES, i % 5).alias("product_category"),
    ).withColumn("total_amount", line_amount())


def simple_sales(ids: DataFrame, run_date: str) -> DataFrame:
    i = F.col("id")
    return ids.select(
        F.format_string("TXN_%05d", i).alias("transaction_id"),
        F.format_string("CUST_%03d", i % 50).alias("customer_id"),
        (F.lit(10.0) + i * F.lit(5.5)).alias("amount"),
        F.lit(run_date).alias("date"),
        pick(REGIONS, i % 4).alias("region"),
    )


def simple_sales_cat(ids: DataFrame, run_date: str) -> DataFrame:
    i = F.col("id")
    return ids.select(
        F.format_string("TXN_%05d", i).alias("transaction_id"),
        F.format_string("CUST_%03d", i % 100).alias("customer_id"),
        (F.lit(10.0) + i * F.lit(2.5)).alias("amount"),
        F.lit(run_date).alias("date"),
        pick(REGIONS, i % 4).alias("region"),
        pick(SIMPLE_CATEGORIES, i % 4).alias("category"),
    )


def random_sales(ids: DataFrame, seed: int = 42, first_date: str = "2024-01-01") -> DataFrame:
    """Random sales spread over the 366 days from first_date."""
    i = F.col("id")
    whole = lambda name, low, high: uniform_int(i, seed, name, low, high)
    day = F.date_add(F.lit(first_date).cast("date"), whole("day", 0, 365))
    return ids.select(
        F.format_string("TXN_%05d", i).alias("transaction_id"),
        F.format_string("CUST_%03d", whole("customer", 1, 100)).alias("customer_id"),
        F.format_string("PROD_%03d", whole("product", 1, 50)).alias("product_id"),
        whole("quantity", 1, 10).alias("quantity"),
        F.round(uniform(i, seed, "price") * 490.0 + 10.0, 2).alias("unit_price"),
        F.date_format(day, "yyyy-MM-dd").alias("transaction_date"),
        pick(REGIONS, whole("region", 0, 3)).alias("region"),
        pick(CATEGORIES, whole("category", 0, 4)).alias("product_category"),
    ).withColumn("total_amount", line_amount())


def random_sales_ext(ids: DataFrame, run_date: str, seed: int = 42) -> DataFrame:
    """Random sales of one day with time of day, customer segment and sales channel."""
    i = F.col("id")
    whole = lambda name, low, high: uniform_int(i, seed, name, low, high)
    second = F.make_interval(secs=whole("second", 0, 86400).cast("decimal(18,6)"))
    moment = F.lit(run_date).cast("timestamp_ntz") + second
    return ids.select(
        F.format_string("TXN_%06d", i).alias("transaction_id"),
        F.format_string("CUST_%04d", whole("customer", 1, 500)).alias("customer_id"),
        F.format_string("PROD_%04d", whole("product", 1, 200)).alias("product_id"),
        whole("quantity", 1, 15).alias("quantity"),
        F.round(uniform(i, seed, "price") * 995.0 + 5.0, 2).alias("unit_price"),
        F.lit(run_date).alias("transaction_date"),
        F.date_format(moment, "HH:mm:ss").alias("transaction_time"),
        pick(WORLD_REGIONS, whole("region", 0, 4)).alias("region"),
        pick(EXT_CATEGORIES, whole("category", 0, 7)).alias("product_category"),
        pick(SEGMENTS, whole("segment", 0, 2)).alias("customer_segment"),
        pick(CHANNELS, whole("channel", 0, 3)).alias("sales_channel"),
    ).withColumn("total_amount", line_amount())


def payments(ids: DataFrame, run_date: str, seed: int = 42) -> DataFrame:
    """One payment a minute from the run date; `id` is kept as the row position."""
    i = F.col("id")
    return ids.select(
        i,
        (i + 1).alias("customer_id"),
        (F.lit(run_date).cast("timestamp") + i * F.expr("interval 1 minute")).alias("transaction_date"),
        normal(i, seed, "amount", 100.0, 25.0).alias("amount"),
        pick(PAYMENT_CATEGORIES, uniform_int(i, seed, "category", 0, 4)).alias("category"),
        pick(PAYMENT_METHODS, uniform_int(i, seed, "method", 0, 3)).alias("payment_method"),
    )


def inject_nulls(
    df: DataFrame, column: str, draws: int, rows: int, seed: int = 42, id_column: str = "id"
) -> DataFrame:
    """Blank a column in the share of rows that `draws` random picks out of `rows` rows,
    repeats allowed, are expected to hit. Which rows these are depends on the id's text, the
    seed and the column's name only."""
    share = 1.0 - (1.0 - 1.0 / rows) ** draws
    hit = lot([id_column], seed, column) < F.lit(round(share * 2**32)).cast("bigint")
    return df.withColumn(column, F.when(~hit, F.col(column)))


def inject_faults(
    df: DataFrame,
    id_column: str = "id",
    amount: str = "amount",
    category: str = "category",
    period: int | None = None,
) -> DataFrame:
    """Seed known defects by row position: no amount in rows 0 to 10, rows 0 to 4 twice,
    a negative amount in row 20 and an unknown category in row 21. With a period the
    pattern repeats every so many rows."""
    position = F.col(id_column) if period is None else F.col(id_column) % period
    broken = df.withColumns(
        {
            amount: F.when(position.between(0, 10), None)
            .when(position == 20, -100.0)
            .otherwise(F.col(amount)),
            category: F.when(position == 21, "InvalidCategory").otherwise(F.col(category)),
        }
    )
    twice = position.between(0, 4)
    copies = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return broken.withColumn("_copy", F.explode(copies)).drop("_copy")


def metrics(
    ids: DataFrame,
    seed: int = 42,
    std: float = 15.0,
    categories: int = 4,
    start: str | None = None,
    step: str = "1 hour",
) -> DataFrame:
    """Category, value and score; with a start also a series of dates one step apart."""
    i = F.col("id")
    columns = [
        pick(METRIC_CATEGORIES[:categories], uniform_int(i, seed, "category", 0, categories - 1))
        .alias("category"),
        normal(i, seed, "value", 100.0, std).alias("value"),
        uniform(i, seed, "score").alias("score"),
    ]
    if start is not None:
        moment = F.lit(start).cast("timestamp_ntz") + i * F.expr(f"interval {step}")
        columns.append(moment.alias("date"))
    return ids.select(*columns)


def date_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias("date"))


def demo_sales(dates: DataFrame, seed: int = 42) -> DataFrame:
    """10 to 49 sales for each row of a frame with a column `date`."""
    day = F.unix_date("date").cast("bigint")
    per_day = uniform_int(day, seed, "rows", 10, 49)
    sale = dates.select("date", F.explode(F.sequence(F.lit(1), per_day)).alias("n"))
    i = F.unix_date("date").cast("bigint") * 100 + F.col("n")
    whole = lambda name, low, high: uniform_int(i, seed, name, low, high)
    return sale.select(
        "date",
        pick(REGIONS, whole("region", 0, 3)).alias("region"),
        pick(PRODUCTS, whole("product", 0, 4)).alias("product"),
        (uniform(i, seed, "amount") * 900.0 + 100.0).alias("sales_amount"),
        whole("quantity", 1, 9).alias("quantity"),
        F.format_string("CUST_%d", whole("customer", 1000, 9998)).alias("customer_id"),
    )
