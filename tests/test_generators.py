from conftest import one, rows
from pyspark.sql import functions as F

from ledgerline.sources import generators

DAY = "2024-01-01"


def test_rows_depend_on_their_id_alone(spark):
    whole = generators.random_sales(spark.range(200))
    spread = generators.random_sales(spark.range(200).repartition(7))
    assert sorted(rows(whole)) == sorted(rows(spread))
    other = generators.random_sales(spark.range(200), seed=7)
    assert sorted(rows(whole)) != sorted(rows(other))


def test_random_sales_cover_their_ranges(spark):
    made = generators.random_sales(spark.range(20000))
    seen = one(
        made.agg(
            F.min("quantity").alias("q0"), F.max("quantity").alias("q1"),
            F.min("unit_price").alias("p0"), F.max("unit_price").alias("p1"),
            F.min("transaction_date").alias("d0"), F.max("transaction_date").alias("d1"),
            F.count_distinct("customer_id").alias("customers"),
            F.count_distinct("product_id").alias("products"),
            F.count_distinct("region").alias("regions"),
        )
    )
    assert (seen["q0"], seen["q1"]) == (1, 10)
    assert 10 <= seen["p0"] < 11 and 499 < seen["p1"] <= 500
    assert (seen["d0"], seen["d1"]) == ("2024-01-01", "2024-12-31")
    assert (seen["customers"], seen["products"], seen["regions"]) == (100, 50, 4)


def test_random_sales_ext_has_time_segment_and_channel(spark):
    made = generators.random_sales_ext(spark.range(5000), DAY)
    assert made.count() == 5000
    assert made.filter(~F.col("transaction_time").rlike(r"^\d\d:\d\d:\d\d$")).count() == 0
    assert {r[0] for r in rows(made.select("customer_segment").distinct())} == set(
        generators.SEGMENTS
    )
    assert made.select("sales_channel").distinct().count() == 4


def test_payments_are_normal_and_a_minute_apart(spark):
    made = generators.payments(generators.row_ids(spark, 10000), DAY)
    moments = one(made.agg(F.avg("amount").alias("mean"), F.stddev("amount").alias("std")))
    assert abs(moments["mean"] - 100) < 1 and abs(moments["std"] - 25) < 1
    last = made.filter("id = 9999").first()
    assert last.customer_id == 10000
    assert str(last.transaction_date) == "2024-01-07 22:39:00"


def test_null_injection_hits_about_the_expected_share(spark):
    made = generators.payments(generators.row_ids(spark, 10000), DAY)
    holed = generators.inject_nulls(made, "amount", 100, 10000)
    assert 60 <= holed.filter("amount is null").count() <= 140
    assert holed.count() == 10000


def test_faults_repeat_with_a_period(spark):
    made = generators.payments(generators.row_ids(spark, 300), DAY)
    faulty = generators.inject_faults(made, period=100)
    assert faulty.count() == 315
    assert faulty.filter("amount is null").count() == 48
    assert faulty.filter("amount = -100").count() == 3
    assert faulty.filter("category = 'InvalidCategory'").count() == 3


def test_metrics_with_dates(spark):
    made = generators.metrics(spark.range(1000), start=DAY, categories=3, step="1 day")
    assert made.columns == ["category", "value", "score", "date"]
    assert made.select("category").distinct().count() == 3
    assert str(made.agg(F.max("date")).first()[0]) == "2026-09-26 00:00:00"


def test_demo_sales_have_10_to_49_rows_a_day(spark):
    days = generators.date_range(spark, "2025-01-01", "2025-07-24")
    per_day = generators.demo_sales(days).groupBy("date").count()
    assert per_day.count() == 205
    assert per_day.filter("count < 10 or count > 49").count() == 0
    made = generators.demo_sales(days)
    assert made.filter("sales_amount < 100 or sales_amount >= 1000").count() == 0
    assert made.filter("quantity < 1 or quantity > 9").count() == 0
