import datetime as dt

import pytest
from conftest import one, rows

from ledgerline.operators import cleaning, profiling, sets

NAN = float("nan")


def test_drop_all_null(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (None, "b")], "n int, s string")
    assert rows(cleaning.drop_all_null(df)) == [(1, "a"), (None, "b")]


@pytest.mark.parametrize("rank_error", [0.01, 0.0])
def test_impute_median(spark, rank_error):
    data = [(1, 1.0, None, "a"), (2, NAN, None, None), (None, 5.0, None, "b"), (4, 9.0, None, "c")]
    df = spark.createDataFrame(data, "i int, d double, none double, s string")
    filled = cleaning.impute_median(df, rank_error)
    assert filled.schema["i"].dataType == df.schema["i"].dataType
    assert rows(filled) == [
        (1, 1.0, None, "a"), (2, 5.0, None, None), (2, 5.0, None, "b"), (4, 9.0, None, "c"),
    ]


def test_exact_median_matches_the_rank_rule(spark):
    data = [(i,) for i in (9, 1, 7, 3)] + [(None,)]
    df = spark.createDataFrame(data, "v bigint")
    expected = df.approxQuantile("v", [0.5], 0.0)[0]
    assert rows(cleaning.impute_median(df, 0.0))[-1] == (expected,)


def test_clean_fills_text_and_drops_empty_rows(spark):
    df = spark.createDataFrame([(1, None), (None, None), (None, "x"), (3, "y")], "n int, s string")
    assert rows(cleaning.clean(df)) == [(1, "Unknown"), (1, "x"), (3, "y")]


def test_frames_without_numbers_or_text(spark):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    assert rows(cleaning.impute_median(df)) == [("a",), (None,)]
    assert rows(profiling.numeric_stats(df)) == []
    numbers = spark.createDataFrame([(1,)], "n int")
    assert rows(cleaning.fill_unknown(numbers)) == [(1,)]


def test_lineage_takes_a_fixed_run_time(spark):
    moment = dt.datetime(2024, 5, 6, 7, 8, 9)
    row = one(cleaning.add_lineage(spark.range(1), moment))
    assert row["processing_timestamp"] == moment
    assert row["processing_date"] == dt.date(2024, 5, 6)
    assert cleaning.add_lineage(spark.range(1)).first().processing_date is not None


def test_small_projections(spark):
    df = spark.createDataFrame([(1.005, 2.346, "a")], "x double, y double, s string")
    assert rows(cleaning.with_constant(df, "day", "d").select("day")) == [("d",)]
    assert rows(cleaning.scatter_points(df, "x", "y")) == [(1.005, 2.346)]
    assert cleaning.preview(spark.range(10), 5).count() == 5
    sampled = cleaning.scatter_points(spark.range(2000).selectExpr("id x", "id y"), "x", "y", 0.1)
    assert 0 < sampled.count() < 2000


@pytest.fixture()
def metrics(spark):
    data = [
        ("a", 1.0, 0.5), ("a", 3.0, 0.1), ("a", NAN, None), ("b", 10.0, 0.2),
        (None, 100.0, 0.9), ("b", None, 0.4),
    ]
    return spark.createDataFrame(data, "category string, value double, score double")


def test_numeric_stats_skip_nan(metrics):
    row = one(profiling.numeric_stats(metrics))
    assert (row["value_count"], row["value_max"], row["value_min"]) == (4, 100.0, 1.0)
    assert row["value_avg"] == 28.5
    assert row["score_count"] == 5


def test_category_stats(metrics):
    result = {r.category: r for r in profiling.category_stats(metrics, digits=4).collect()}
    assert set(result) == {"a", "b"}
    assert (result["a"].value_mean, result["a"].value_std, result["a"].value_count) == (
        2.0, 1.4142, 2,
    )
    assert result["b"].value_std is None


def test_summary_metrics(metrics):
    row = one(profiling.summary_metrics(metrics, "2024-01-01"))
    assert row["total_records"] == 6 and row["categories"] == 2
    assert row["median_value"] == 6.5


def test_describe_and_box(spark, metrics):
    table = {r.column: r for r in profiling.describe(metrics).collect()}
    value = table["value"]
    assert (value["count"], value["min"], value["max"]) == (4, 1.0, 100.0)
    assert (value.q25, value.median, value.q75) == (2.5, 6.5, 32.5)
    assert set(table) == {"value", "score"}
    boxes = {r[0]: r[1:] for r in rows(profiling.box_stats(metrics, "value", "category"))}
    assert boxes == {"a": (1.0, 1.5, 2.0, 2.5, 3.0), "b": (10.0, 10.0, 10.0, 10.0, 10.0)}


def test_describe_lists_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, y double")
    assert {r[0]: r[1] for r in rows(profiling.describe(df))} == {"x": 1, "y": 0}


def test_histogram_matches_numpy(spark):
    import numpy as np

    values = np.random.default_rng(3).normal(0, 1, 2000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (NAN,)], "v double")
    counts, edges = np.histogram(values, bins=30)
    found = profiling.histogram(df, "v").collect()
    assert [r["count"] for r in found] == list(counts)
    assert [r.bin_start for r in found] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    found = [r for r in profiling.histogram(df, "v", 4).collect() if r["count"]]
    assert [(r.bin, r["count"]) for r in found] == [(2, 2)]


def test_value_counts_and_ingest(metrics):
    assert rows(profiling.value_counts(metrics, "category")) == [("a", 3), ("b", 2)]
    flat = rows(profiling.ingest_metadata(metrics, ["value", "category"]))
    assert sorted(flat) == [
        ("categories", "a", 3), ("categories", "b", 2), ("missing_values", "category", 1),
        ("missing_values", "value", 2), ("total_records", "rows", 6),
    ]


def test_profile_range(metrics):
    assert one(profiling.profile_range(metrics, "category")) == {
        "total_rows": 6, "first_value": "a", "last_value": "b", "total_columns": 3,
    }
    assert profiling.distinct_values(metrics, "category").count() == 3
    overall = one(profiling.overall_metrics(metrics))
    assert (overall["total_records"], overall["average_value"]) == (6, 28.5)


def test_set_operations(spark):
    df = spark.createDataFrame([(0, None), (1, None), (1, None), (2, "x")], "id int, s string")
    assert sets.dedupe(df).count() == 3
    assert one(sets.duplicate_totals(df)) == {"total_records": 4, "unique_records": 3}
    assert one(sets.duplicate_totals(df.limit(0))) == {"total_records": 0, "unique_records": 0}
    assert sets.append_first(df, "id", 2).count() == 7
    swapped = df.select("s", "id")
    assert sets.append_rows(df, swapped).columns == ["id", "s"]
