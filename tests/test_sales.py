"""The star and the flat frame give the same sales; missing keys follow each operator."""

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from ledgerline.operators import summaries
from ledgerline.sources.sales import FlatSales, StarSales, fold

KEYS = [
    (),
    ("region",),
    ("customer_id",),
    ("product_id",),
    ("product_category",),
    ("transaction_date",),
    ("sales_channel", "customer_segment"),
    ("customer_segment", "customer_id"),
    ("region", "product_category"),
]


@pytest.mark.parametrize("keys", KEYS, ids="-".join)
def test_star_tally_equals_flat_tally(spark, folder, keys):
    star = StarSales(spark, folder)
    columns = [*keys, "rows", "transactions", "amounts", "units", F.round("revenue", 2), "high"]
    expected = FlatSales(star.rows()).tally(*keys).select(columns)
    assert sorted(rows(star.tally(*keys).select(columns))) == sorted(rows(expected))


@pytest.mark.parametrize(
    "column, value",
    [("region", "ASIA"), ("transaction_date", "1999-01-16"), ("product_category", "ECONOMY")],
)
def test_filters_agree(spark, folder, column, value):
    star = StarSales(spark, folder).where(column, value)
    flat = FlatSales(StarSales(spark, folder).rows()).where(column, value)
    columns = ["customer_id", "rows", F.round("revenue", 2)]
    expected = sorted(rows(flat.tally("customer_id").select(columns)))
    assert expected
    assert sorted(rows(star.tally("customer_id").select(columns))) == expected


def test_rows_only_read_the_tables_they_need(spark, folder):
    plan = StarSales(spark, folder).rows("product_category", "total_amount")
    read = {f.rsplit("/", 1)[-1] for f in plan.inputFiles()}
    assert read == {"lineitem.parquet", "part.parquet"}


def test_a_line_without_its_order_is_kept(spark, tmp_path, folder):
    for name in ("region", "nation", "customer", "part", "lineitem"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").filter("o_orderkey > 10")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    star = StarSales(spark, str(tmp_path))
    everything = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    by_region = star.tally("region")
    assert by_region.agg(F.sum("rows")).first()[0] == everything
    assert by_region.filter("region is null").count() == 1


SMALL = [
    ("t1", "c1", "p1", 1, 1.0, "2024-01-02", "N", "A", 10.0),
    ("t2", "c1", "p2", 2, 1.0, "2024-01-01", None, "A", 20.0),
    ("t3", None, "p2", None, 1.0, None, "N", None, float("nan")),
    (None, "c2", None, 3, 1.0, "2024-01-01", "S", "B", 20.005),
    ("t5", "c3", "p1", 1, 1.0, "2024-01-01", "S", "B", None),
]


@pytest.fixture()
def small(spark):
    return spark.createDataFrame(
        SMALL,
        "transaction_id string, customer_id string, product_id string, quantity int, "
        "unit_price double, transaction_date string, region string, product_category string, "
        "total_amount double",
    )


def test_missing_keys_are_kept_or_dropped(small):
    assert {r.region for r in summaries.region_summary(small).collect()} == {"N", "S", None}
    assert [r.region for r in summaries.region_sales(small).collect()] == ["N", "S"]
    assert [r.transaction_date for r in summaries.daily_sales(small).collect()] == [
        "2024-01-01", "2024-01-02",
    ]


def test_nan_is_missing_in_sums_and_counts(small):
    north = summaries.region_summary(small).filter("region = 'N'").first()
    assert (north.total_revenue, north.avg_order_value, north.order_count) == (10.0, 10.0, 2)


def test_distinct_counts_with_and_without_missing(small):
    final = one(summaries.final_counts(small))
    assert (final["unique_customers"], final["unique_products"]) == (4, 3)
    assert (final["unique_regions"], final["unique_categories"]) == (3, 3)
    summary = one(summaries.processing_summary(small, "2024-01-01"))
    assert (summary["unique_customers"], summary["unique_products"]) == (3, 2)
    assert (summary["regions_covered"], summary["categories_covered"]) == (2, 2)
    assert summary["total_revenue"] == pytest.approx(50.005)
    assert summary["avg_order_value"] == pytest.approx(50.005 / 3)


def test_daily_metrics_take_the_earliest_date(small):
    assert one(summaries.daily_metrics(small))["processing_date"] == "2024-01-01"


def test_ties_go_to_the_smaller_key(spark):
    data = [(f"c{i}", 10.0) for i in (3, 1, 2)] + [("c0", 1.0)]
    tied = FlatSales(spark.createDataFrame(data, "customer_id string, total_amount double"))
    assert [r.customer_id for r in summaries.top_customers(tied, 2).collect()] == ["c1", "c2"]
    assert summaries.top_group(tied, "customer_id").first().customer_id == "c1"
    assert [r.customer_id for r in summaries.top5_customers(tied, 3).collect()] == [
        "c1", "c2", "c3",
    ]


def test_means_round_half_up_on_exact_ties(spark):
    amounts = [0.01] * 3 + [0.02] * 5  # 0.13 / 8 = 0.01625; 41472.645 needs 28 rows
    assert one(
        summaries.region_analysis(
            spark.createDataFrame([("N", a) for a in amounts], "region string, total_amount double")
        )
    )["avg_order_value"] == 0.02
    tie = [(("N"), 1161234.06 / 2)] * 2 + [("N", 0.0)] * 26
    df = spark.createDataFrame(tie, "region string, total_amount double")
    assert one(summaries.region_analysis(df))["avg_order_value"] == 41472.65


def test_segment_average_divides_rounded_revenue(spark):
    data = [("s", "c1", 10.004), ("s", "c2", 10.004), ("s", None, 10.004), ("s", "c1", 0.0)]
    df = spark.createDataFrame(
        data, "customer_segment string, customer_id string, total_amount double"
    )
    assert rows(summaries.segment_analysis(df)) == [("s", 30.01, 3, 10.0)]


def test_executive_summary(spark):
    data = [
        ("c1", "p1", "N", "A", "Premium", "Online", 10.0),
        ("c2", "p1", "N", "B", "Economy", "Phone", 5.0),
        ("c1", "p2", "S", "B", "Premium", "Phone", 15.0),
    ]
    df = spark.createDataFrame(
        data,
        "customer_id string, product_id string, region string, product_category string, "
        "customer_segment string, sales_channel string, total_amount double",
    )
    assert one(summaries.executive_summary(df, "2024-01-01")) == {
        "processing_date": "2024-01-01", "total_records_processed": 3, "total_revenue": 30.0,
        "avg_transaction_value": 10.0, "unique_customers": 2, "unique_products": 2,
        "regions_covered": 2, "categories_covered": 2, "top_region": "N", "top_category": "B",
        "top_segment": "Premium", "top_channel": "Phone",
    }


def test_no_rows(small):
    none = small.limit(0)
    assert rows(summaries.region_summary(none)) == []
    assert one(summaries.final_counts(none)) == {
        "total_records": 0, "total_revenue": None, "unique_customers": 0,
        "unique_products": 0, "unique_regions": 0, "unique_categories": 0,
    }
    assert one(summaries.daily_metrics(none))["total_transactions"] == 0


def test_region_filter(small):
    assert one(summaries.analysis_summary(small, "d", "S"))["records_processed"] == 2
    assert one(summaries.analysis_summary(small, "d"))["records_processed"] == 5
    assert one(summaries.analysis_summary(small, "d"))["unique_customers"] == 3


def test_last_days_and_ranking(spark):
    data = [(f"2024-01-{d:02d}", "r%d" % (d % 3), float(d)) for d in range(1, 32)]
    df = spark.createDataFrame(data, "transaction_date string, region string, total_amount double")
    last = summaries.last_days(df, 30).collect()
    assert (len(last), last[0][0], last[-1][0]) == (30, "2024-01-02", "2024-01-31")
    down = [r.total_amount for r in summaries.ranked_sales(df, "region").collect()]
    up = [r.total_amount for r in summaries.ranked_sales(df, "region", True).collect()]
    assert down == sorted(down, reverse=True) and up == down[::-1]


def test_folded_sales_answer_within_their_families(spark, folder):
    star = StarSales(spark, folder)
    folded = fold(star, ("customer_id", "region"), ("product_id", "product_category"))
    columns = ["rows", "transactions", "units", F.round("revenue", 2), "high", "low"]
    for keys in ((), ("region",), ("customer_id",), ("product_category",)):
        expected = sorted(rows(star.tally(*keys).select(*keys, *columns)))
        assert sorted(rows(folded.tally(*keys).select(*keys, *columns))) == expected
    assert rows(summaries.final_counts(folded)) == rows(summaries.final_counts(star))
    assert rows(summaries.analysis_summary(folded, "d", "ASIA", 2)) == rows(
        summaries.analysis_summary(star, "d", "ASIA", 2)
    )
    with pytest.raises(ValueError, match="no family"):
        folded.tally("region", "product_category")
    with pytest.raises(ValueError, match="no family"):
        folded.where("sales_channel", "x")
