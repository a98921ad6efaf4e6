"""Published and recomputed results on the deterministic fixtures."""

from conftest import one, rows

from ledgerline.operators import cleaning, profiling, quality, summaries
from ledgerline.sources import generators
from ledgerline.sources.sales import FlatSales

DAY = "2024-01-01"


def sales(spark):
    return generators.sales(generators.row_ids(spark, 1000), DAY)


def test_region_summary(spark):
    result = summaries.region_summary(sales(spark)).collect()
    assert [(r.region, r.total_revenue) for r in result] == [
        ("West", 91750.0), ("South", 90250.0), ("East", 76000.0), ("North", 74750.0),
    ]
    assert {r.region: (r.order_count, r.total_quantity) for r in result} == {
        "North": (250, 1250), "South": (250, 1500), "East": (250, 1250), "West": (250, 1500),
    }


def test_category_summary(spark):
    result = summaries.category_summary(sales(spark)).collect()
    assert [(r.product_category, r.total_revenue) for r in result] == [
        ("Sports", 91750.0), ("Home", 78950.0), ("Books", 66350.0),
        ("Clothing", 53950.0), ("Electronics", 41750.0),
    ]


def test_daily_metrics(spark):
    assert one(summaries.daily_metrics(sales(spark))) == {
        "total_transactions": 1000, "total_revenue": 332750.0, "avg_transaction_value": 332.75,
        "total_items_sold": 5500, "processing_date": DAY,
    }


def test_top_customers(spark):
    result = summaries.top_customers(sales(spark)).collect()
    assert len(result) == 50
    assert [(r.customer_id, r.total_spent) for r in result[:4]] == [
        ("CUST_099", 8450.0), ("CUST_089", 7950.0), ("CUST_098", 7560.0), ("CUST_079", 7450.0),
    ]


def test_final_counts(spark):
    assert one(summaries.final_counts(sales(spark))) == {
        "total_records": 1000, "total_revenue": 332750.0, "unique_customers": 100,
        "unique_products": 50, "unique_regions": 4, "unique_categories": 5,
    }


def test_simple_sales(spark):
    made = generators.simple_sales(generators.row_ids(spark, 100), DAY)
    simple = FlatSales(made, amount="amount")
    totals = one(summaries.simple_totals(simple, DAY))
    assert totals == {
        "processing_date": DAY, "total_records_processed": 100, "total_revenue": 28225.0,
        "avg_transaction_value": 282.25, "unique_customers": 50,
    }
    assert dict(rows(summaries.region_breakdown(simple))) == {
        "North": 6850.0, "South": 6987.5, "East": 7125.0, "West": 7262.5,
    }
    top = rows(summaries.top5_customers(simple))
    assert top[0] == ("CUST_049", 834.0) and top[-1] == ("CUST_045", 790.0) and len(top) == 5


def test_key_summaries_of_simple_sales(spark):
    made = generators.simple_sales_cat(generators.row_ids(spark, 1000), DAY)
    keys = {"region": "region", "category": "category", "customer": "customer_id"}
    by_set = summaries.grouped_key_summaries(made, keys)
    by_key = summaries.key_summaries(FlatSales(made, amount="amount"), keys)
    columns = ["summary", "key", "total_amount", "count", "average_amount"]
    assert sorted(rows(by_set.select(columns))) == sorted(rows(by_key.select(columns)))
    regions = {r.key: r.total_amount for r in by_set.filter("summary = 'region'").collect()}
    assert regions == {"North": 313750.0, "South": 314375.0, "East": 315000.0, "West": 315625.0}
    assert by_set.filter("summary = 'customer'").count() == 100


def test_fault_injection_and_quality(spark):
    made = generators.payments(generators.row_ids(spark, 9500), DAY)
    faulty = generators.inject_faults(made).drop("id")
    assert faulty.count() == 9505
    missing = {r.column_name: r for r in quality.completeness(faulty).collect()}
    assert missing["amount"].missing_count == 16 and missing["amount"].passed
    assert round(missing["amount"].missing_percentage, 2) == 0.17
    unique = one(quality.uniqueness(faulty))
    assert unique["duplicate_count"] == 5 and unique["passed"]
    assert rows(quality.validity(faulty)) == [("amount", 1, False), ("customer_id", 0, True)]
    assert rows(quality.consistency(faulty)) == [
        ("category", 1, False), ("payment_method", 0, True),
    ]
    assert rows(quality.bad_values(faulty)) == [("category", "InvalidCategory", 1)]
    assert one(quality.overall(faulty)) == {
        "total_records": 9505, "overall_status": "FAILED",
        "total_tests": 4, "passed_tests": 2, "failed_tests": 2,
    }


def test_ids_beyond_the_padding_keep_all_digits(spark):
    made = generators.sales(spark.range(123456, 123457), DAY)
    assert made.first().transaction_id == "TXN_123456"


def test_line_amount_matches_the_generator(spark):
    made = sales(spark)
    again = cleaning.with_line_amount(made.drop("total_amount"))
    assert rows(again.select("total_amount")) == rows(made.select("total_amount"))


def test_frame_summary(spark):
    summary = one(profiling.frame_summary(sales(spark)).drop("processing_timestamp"))
    assert summary == {"total_rows": 1000, "total_columns": 9, "numeric_columns": 3}
