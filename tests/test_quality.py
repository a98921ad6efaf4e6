import json

from conftest import one, rows

from ledgerline.operators import quality
from ledgerline.operators.quality import QualityRules
from ledgerline.sinks.documents import quality_document

RULES = QualityRules(
    max_missing=0.25,
    max_duplicates=0.25,
    ranges={"amount": (0, 100)},
    allowed={"category": ["a", "b"]},
)
LAYOUT = "amount double, category string"


def make(spark, data):
    return spark.createDataFrame(data, LAYOUT)


def test_completeness_just_at_and_just_over(spark):
    at = make(spark, [(None, "a"), (1.0, "a"), (2.0, "a"), (3.0, "b")])
    assert [r.passed for r in quality.completeness(at, RULES).collect()] == [True, True]
    over = make(spark, [(None, "a"), (float("nan"), "a"), (2.0, "a"), (3.0, "b")])
    found = {r.column_name: r for r in quality.completeness(over, RULES).collect()}
    assert (found["amount"].missing_count, found["amount"].passed) == (2, False)


def test_uniqueness_treats_nulls_as_equal(spark):
    at = make(spark, [(1.0, None), (1.0, None), (2.0, "a"), (3.0, "a")])
    assert one(quality.uniqueness(at, RULES)) == {
        "total_records": 4, "unique_records": 3, "duplicate_count": 1,
        "duplicate_percentage": 25.0, "passed": True,
    }
    over = make(spark, [(1.0, None), (1.0, None), (1.0, None), (3.0, "a")])
    assert not one(quality.uniqueness(over, RULES))["passed"]


def test_range_ends_are_inside_and_missing_is_no_violation(spark):
    df = make(spark, [(0.0, "a"), (100.0, "a"), (-0.01, "a"), (100.01, "a"), (None, "a")])
    assert rows(quality.validity(df, RULES)) == [("amount", 2, False)]
    assert quality.range_violations(df, "amount", (0, 100)).count() == 2
    assert quality.range_violations(df, "amount", (0, None)).count() == 1


def test_missing_is_a_violation_of_allowed_values(spark):
    df = make(spark, [(1.0, "a"), (1.0, None), (1.0, "z"), (1.0, "z")])
    assert rows(quality.consistency(df, RULES)) == [("category", 3, False)]
    assert set(rows(quality.bad_values(df, RULES))) == {
        ("category", None, 1), ("category", "z", 2),
    }
    assert quality.disallowed_rows(df, "category", ["a"]).count() == 3


def test_overall_passes_and_fails(spark):
    good = make(spark, [(1.0, "a"), (2.0, "b")])
    assert one(quality.overall(good, RULES))["overall_status"] == "PASSED"
    bad = make(spark, [(-1.0, "a"), (None, "z")])
    assert one(quality.overall(bad, RULES)) == {
        "total_records": 2, "overall_status": "FAILED",
        "total_tests": 4, "passed_tests": 1, "failed_tests": 3,
    }


def test_no_rows_pass(spark):
    assert one(quality.overall(make(spark, []), RULES))["overall_status"] == "PASSED"


def test_rules_without_checks(spark):
    none = QualityRules(ranges={}, allowed={})
    df = make(spark, [(1.0, "a")])
    assert rows(quality.validity(df, none)) == []
    assert one(quality.overall(df, none))["passed_tests"] == 4


def test_report_document(spark):
    df = make(spark, [(-1.0, "a"), (None, "z"), (None, "z")])
    report = json.loads(quality_document(df, "2024-01-01", RULES).first().value)
    assert report["overall_status"] == "FAILED"
    assert report["total_records"] == 3
    assert report["tests"]["completeness"]["missing_data"] == {"amount": 2, "category": 0}
    assert report["tests"]["uniqueness"]["duplicate_count"] == 1
    assert report["tests"]["validity"]["details"]["amount_range"] == {
        "passed": False, "invalid_count": 1,
    }
    assert report["tests_summary"] == {"total_tests": 4, "passed_tests": 0, "failed_tests": 4}
