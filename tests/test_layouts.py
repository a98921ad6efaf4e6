"""Stored layouts: what their plans leave out."""

import re

from conftest import one, rows
from pyspark.sql import functions as F

from ledgerline.operators import summaries
from ledgerline.plans import queries
from ledgerline.sources import generators, layouts
from ledgerline.sources.sales import FlatSales


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_by_the_bucketed_key_need_no_shuffle(spark):
    sales = FlatSales(generators.sales(spark.range(900), "2024-01-01"))
    later = FlatSales(generators.sales(spark.range(400), "2024-01-02"))
    both = FlatSales(sales.df.unionByName(later.df))
    layouts.write_keyed_tally(both, "tally_by_customer", "customer_id", buckets=3)
    table = layouts.keyed_tally(spark, "tally_by_customer", "customer_id")
    totals = summaries.customer_totals(table, 2)
    plan = plan_of(totals)
    assert "HashAggregate" in plan and "Exchange" not in plan[plan.index("HashAggregate") :]
    assert sorted(rows(totals)) == sorted(rows(summaries.customer_totals(both, 2)))
    assert rows(summaries.top5_customers(table, digits=2)) == rows(summaries.top5_customers(both, digits=2))
    assert one(table.tally().select("rows", "revenue"))["rows"] == 1300


def test_only_the_folders_of_chosen_runs_are_read(spark, folder, tmp_path):
    lines = spark.range(3000).selectExpr("id", "id % 10 as day", "id * 2 as v")
    path = str(tmp_path / "lines")
    layouts.write_lines_by_run(lines, path, F.when(F.col("day") < 9, F.concat(F.lit("d"), "day")))
    days = spark.createDataFrame([("d3", 1), ("d3", 1), ("d8", 2), (None, 1), ("d0", 5)], "run string, kind int")
    chosen = layouts.lines_of(spark, path, days.filter("kind < 3"))
    assert sorted(rows(chosen.select("id"))) == [(i,) for i in range(3000) if i % 10 in (3, 8)]
    plan = plan_of(queries.QUERIES["lines_of_a_run"](spark, folder))
    assert re.search("PartitionFilters: .*dynamicpruning", plan)


def test_a_profile_from_footers_reads_no_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.range(5, 500).selectExpr("if(id % 5 = 0, null, id) as k", "id / 4 as d").repartition(3).write.parquet(path)
    found = layouts.footer_profile(spark, path, "k")
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), MIN\(k\), MAX\(k\)\]", plan_of(found))
    assert one(found) == {"total_rows": 495, "first_value": 6, "last_value": 499}
    assert one(layouts.footer_profile(spark, path, "d"))["last_value"] == 499 / 4
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
