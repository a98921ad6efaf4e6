"""What the physical plans must and must not contain."""

import re

from ledgerline.operators import summaries
from ledgerline.plans.queries import daily_slice
from ledgerline.sources.sales import StarSales


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, folder):
    found = plan(summaries.category_analysis(StarSales(spark, folder)))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in found
    assert "orders.parquet" not in found and "customer.parquet" not in found


def test_top_k_does_not_sort_everything(spark, folder):
    found = plan(summaries.top_customers(StarSales(spark, folder)))
    assert "TakeOrderedAndProject" in found and "rangepartitioning" not in found


def test_region_filter_reaches_the_scan(spark, folder):
    star = StarSales(spark, folder).where("region", "ASIA")
    assert "EqualTo(r_name,ASIA)" in plan(star.rows("region", "total_amount"))
    assert "EqualTo(r_name,ASIA)" in plan(star.tally("customer_id"))


def test_joins_meet_folded_rows(spark, folder, monkeypatch):
    """Without broadcasts the join on the order key sits right on the aggregate by it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(summaries.region_summary(StarSales(spark, folder)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", found)
    # lines and orders by order, folded orders and customers by customer, region twice
    # for the nation and region tables, and the result: no exchange of raw joined rows.
    assert exchanges.count("order_id") == 2 and exchanges.count("customer_id") == 2


def test_key_summaries_scan_the_lines_twice(spark, folder):
    star = StarSales(spark, folder)
    keys = {"region": "region", "category": "product_category", "customer": "customer_id"}
    found = plan(summaries.key_summaries(star, keys, 2, together=[["customer_id", "region"]]))
    assert found.split("\n\n")[0].count("l_extendedprice") > 0
    assert len(re.findall(r"FileScan parquet.*lineitem", found)) == 2


def test_a_days_plan_starts_no_job(spark, folder):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "plans only")
    daily_slice(spark, folder)
    summaries.simple_summary(StarSales(spark, folder), "2024-01-01")
    assert list(tracker.getJobIdsForGroup("lazy")) == []
