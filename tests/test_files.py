"""Readers, writers, documents, listings."""

import os

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.session import (
    build_session,
    materialize,
    object_store_conf,
    scratch_dir,
    scratch_scope,
)
from ledgerline.plans import queries
from ledgerline.sinks import verify, writers
from ledgerline.sources import files, generators, readers


def text(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_json_bad_lines_become_null_rows_and_can_be_kept_apart(spark, tmp_path):
    path = text(
        tmp_path / "s.json",
        '{"transaction_id": "t1", "quantity": 2, "total_amount": 3.5, "extra": 1}',
        "not json",
        '{"transaction_id": "t2", "quantity": "many", "total_amount": 1.0}',
    )
    plain = readers.read_sales(spark, path)
    assert plain.count() == 3
    assert plain.filter("transaction_id is null").count() == 1
    assert plain.filter("transaction_id = 't2'").first().quantity is None
    good, bad = readers.split_corrupt(
        readers.read_json(spark, path, schemas.SALES, quarantine=True)
    )
    assert [r[0] for r in rows(good.select("transaction_id"))] == ["t1"]
    assert bad.count() == 2


def test_empty_input_raises(spark, tmp_path):
    path = text(tmp_path / "empty.json", "")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_sales(spark, path)


def test_csv_inference_and_schema(spark, tmp_path):
    path = text(tmp_path / "a.csv", "id,n,when", "TXN_001,1,2025-07-23", "TXN_002,,2025-07-24")
    assert dict(readers.read_csv(spark, path).dtypes) == {
        "id": "string", "n": "int", "when": "date",
    }


def test_sales_csv_is_read_by_name(spark, tmp_path):
    path = text(
        tmp_path / "s.csv",
        "transaction_id,customer_id,product_id,category,region,quantity,unit_price,"
        "total_amount,transaction_date,note",
        "A1,C9,P3,Toys,Hill,4,2.50,10.00,2031-05-06,x",
        "A2,C8,P4,Tools,Dale,many,1.00,,2031-05-07,y",
    )
    df = readers.read_sales_csv(spark, path)
    assert df.columns == schemas.SALES.fieldNames() and df.schema == schemas.SALES
    first, second = df.orderBy("transaction_id").collect()
    assert (first.product_category, first.region, first.quantity) == ("Toys", "Hill", 4)
    assert (first.total_amount, first.transaction_date) == (10.0, "2031-05-06")
    assert (second.quantity, second.total_amount, second.unit_price) == (None, None, 1.0)
    short = text(tmp_path / "t.csv", "transaction_id,region", "A1,Hill")
    with pytest.raises(ValueError, match="no column customer_id"):
        readers.read_sales_csv(spark, short)


def test_dated_csv(spark, tmp_path):
    path = text(tmp_path / "d.csv", "date,region", "2025-01-02,N", "soon,S")
    layout = schemas.layout(date=schemas.DEMO_SALES["date"].dataType, region=schemas.TEXT)
    found = rows(readers.read_dated_csv(spark, path, layout, "date"))
    assert [str(r[0]) for r in found] == ["2025-01-02", "None"]


def test_run_slice_prunes_partitions(spark, tmp_path):
    made = generators.sales(spark.range(40), "x").withColumn(
        "ds", F.when(F.col("region") == "North", "2024-01-01").otherwise("2024-01-02")
    )
    made.write.partitionBy("ds").parquet(str(tmp_path / "p"))
    part = readers.run_slice(spark.read.parquet(str(tmp_path / "p")), "2024-01-01")
    assert part.count() == 10
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ds" in plan
    assert readers.run_file("in/", "2024-01-01", "csv") == "in/sales_2024-01-01.csv"


def test_create_once_then_reuse(spark, tmp_path):
    path = str(tmp_path / "metrics")
    layout = schemas.METRICS
    first = readers.read_or_create(spark, path, layout, generators.metrics(spark.range(10)))
    assert first.count() == 10
    again = readers.read_or_create(spark, path, layout, generators.metrics(spark.range(99)))
    assert again.count() == 10
    (tmp_path / "metrics" / "_SUCCESS").unlink()  # as if the write had been broken off
    repaired = readers.read_or_create(spark, path, layout, generators.metrics(spark.range(7)))
    assert repaired.count() == 7


@pytest.mark.parametrize("single", [True, False])
def test_round_trips(spark, tmp_path, single):
    df = generators.sales(spark.range(100), "2024-01-01").repartition(3)
    expected = sorted(rows(df))
    for kind in ("csv", "parquet", "json"):
        target = str(tmp_path / kind)
        getattr(writers, f"write_{kind}")(df, target, single)
        reader = spark.read.schema(schemas.SALES).option("header", True)
        back = reader.format(kind).load(target)
        assert sorted(rows(back.select(df.columns))) == expected
        parts = list((tmp_path / kind).glob("part-*"))
        assert (len(parts) == 1) is single


def test_overwriting_the_input_is_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)
    df = spark.read.parquet(path)
    for target in (path, path + "/", str(tmp_path), "file://" + path):
        with pytest.raises(ValueError, match="input file"):
            writers.write_parquet(df.limit(1), target)
    writers.write_parquet(df.limit(1), path + "_other")
    assert df.count() == 10


def test_covers():
    assert writers.covers("s3a://b/data", "s3a://b/data/part-0")
    assert not writers.covers("s3a://b/data", "s3a://c/data/part-0")
    assert not writers.covers("s3a://b/data", "s3a://b/database/part-0")
    with pytest.raises(ValueError, match="overlap"):
        writers.check_distinct("/out", "/out/stats")
    writers.check_distinct("/out/data", "/out/stats")


def test_runs_live_side_by_side(spark, tmp_path):
    target = str(tmp_path / "runs")
    writers.write_run(spark.range(3), target, "2024-01-01")
    writers.write_run(spark.range(5), target, "2024-01-02")
    writers.write_run(spark.range(4), target, "2024-01-01")
    back = spark.read.option("header", True).csv(target).groupBy("processing_date").count()
    assert {str(r[0]): r[1] for r in rows(back)} == {"2024-01-01": 4, "2024-01-02": 5}


def test_keyed_reports_are_json_lines_from_several_tasks(spark, tmp_path):
    """Any number of keys, a missing one and the text `null` among them."""
    target = str(tmp_path / "report")
    df = spark.range(200_000).selectExpr("cast(id as string) k", "id n").repartition(3)
    odd = spark.createDataFrame([(None, 1), ("null", 2)], "k string, n bigint")
    writers.write_json(df.unionByName(odd), target)
    assert len(list((tmp_path / "report").glob("part-*"))) > 1
    back = spark.read.schema("k string, n bigint").json(target)
    assert back.count() == 200_002 and back.filter("k is null").first().n == 1


def test_inventory_and_verification(spark, tmp_path):
    for name, size in (("out/a/part-0", 3), ("out/a/part-1", 4), ("out/b.json", 5), ("in/c", 9)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * size)
    listed = files.file_inventory(spark, str(tmp_path))
    assert one(files.inventory_totals(listed)) == {"total_objects": 4, "total_size": 21}
    assert files.recent_files(listed, 2).count() == 2
    assert [r.size for r in files.first_files(listed, 1).collect()] == [9]
    found = verify.verify_outputs(spark, str(tmp_path), ["out/a/", "out/b.json", "out/c"])
    assert {r.expected: (r.exists, r.files, r.total_size) for r in found.collect()} == {
        "out/a/": (True, 2, 7), "out/b.json": (True, 1, 5), "out/c": (False, 0, 0),
    }
    assert rows(verify.missing_outputs(found)) == [("out/c",)]
    # A base whose name is part of other folders' names counts from the root.
    (tmp_path / "checkout" / "out").mkdir(parents=True)
    (tmp_path / "checkout" / "out" / "d").write_text("xx")
    below = verify.verify_outputs(spark, str(tmp_path / "checkout"), ["out/d", "d", "out"])
    assert [r.exists for r in below.orderBy("expected").collect()] == [False, True, True]
    absent = verify.verify_outputs(spark, str(tmp_path / "nowhere"), ["x"])
    assert rows(verify.missing_outputs(absent)) == [("x",)]


def test_listing_does_not_read_contents(spark, folder):
    plan = files.file_inventory(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_object_store_settings():
    conf = object_store_conf(
        {"AWS_ENDPOINT_URL": "http://store:4566", "AWS_ACCESS_KEY_ID": "k",
         "AWS_SECRET_ACCESS_KEY": "s", "AWS_DEFAULT_REGION": "us-east-1"}
    )
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:4566"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.access.key"] == "k"
    assert object_store_conf({}) == {}


def test_the_clusters_settings_win(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert build_session(env={}).conf.get("spark.sql.session.timeZone") == "UTC"
    asked = build_session(conf={"spark.sql.session.timeZone": "Asia/Tokyo"}, env={})
    assert asked.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    # This session's configuration names a time zone, so the default leaves it alone.
    assert build_session(env={}).conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scratch_is_shared_and_tidied(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with scratch_scope(spark):
        (kept,) = materialize(spark.range(3)).inputFiles()[:1]
        assert os.path.exists(kept.removeprefix("file://"))
    assert not os.path.exists(kept.removeprefix("file://"))
    files = materialize(spark.range(3)).inputFiles()
    assert all(os.path.exists(f.removeprefix("file://")) for f in files)


@pytest.mark.parametrize("name", ["bad_lines", "json_scan"])
def test_lines_made_from_the_star_are_written_small(spark, folder, tmp_path, monkeypatch, name):
    paths = (str(tmp_path / f"p{i}") for i in range(9))
    monkeypatch.setattr(queries, "_path", lambda spark: next(paths))
    queries.QUERIES[name](spark, folder).collect()
    made = spark.read.text(str(tmp_path / "p0"))  # the lines come first
    plain = made.selectExpr("sum(octet_length(value))").first()[0]
    written = sum(f.stat().st_size for f in (tmp_path / "p0").glob("part-*"))
    assert made.count() > 1000 and 0 < written < plain / 4
