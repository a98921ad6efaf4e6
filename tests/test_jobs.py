import datetime as dt
import json
import pathlib

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.__main__ import arguments, main
from ledgerline.operators import summaries
from ledgerline.plans import jobs
from ledgerline.sources import generators
from ledgerline.streaming.runs import collect_key_summaries, merged_key_summaries

DAY = "2024-01-01"


def one_file(df, path, kind="json"):
    """Write a frame as the single file that one run leaves behind."""
    path.parent.mkdir(parents=True, exist_ok=True)
    if kind == "json":
        path.write_text("\n".join(df.toJSON().collect()))
    else:
        df.toPandas().to_csv(path, index=False)


def document(folder):
    (part,) = folder.glob("part-*")
    return json.loads(part.read_text())


def test_sales_job(spark, tmp_path):
    generators.sales(spark.range(1000), DAY).write.json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    counts = jobs.run_sales_job(spark, str(tmp_path / "in"), out)
    assert one(counts)["total_records"] == 1000
    verified = jobs.verify_sales_job(spark, out).collect()
    assert len(verified) == 4 and all(r.exists for r in verified)
    regions = spark.read.parquet(out + "/aggregations/region_summary").collect()
    assert [r.region for r in regions] == ["West", "South", "East", "North"]
    assert spark.read.parquet(out + "/analytics/top_customers").count() == 50


def test_sales_job_refuses_to_overwrite_its_input(spark, tmp_path):
    inside = str(tmp_path / "metrics" / "daily_summary")
    generators.sales(spark.range(10), DAY).write.json(inside)
    with pytest.raises(ValueError, match="input file"):
        jobs.run_sales_job(spark, inside, str(tmp_path))


def test_dated_jobs_refuse_to_overwrite_their_input(spark, tmp_path):
    inside = tmp_path / "daily-sales"
    one_file(generators.random_sales(spark.range(5)), inside / f"sales_{DAY}.csv", "csv")
    with pytest.raises(ValueError, match="input file"):
        jobs.run_daily_job(spark, str(inside), str(tmp_path), DAY)
    inside = tmp_path / "regional-summary" / DAY
    one_file(generators.simple_sales_cat(spark.range(5), DAY), inside / f"sales_{DAY}.json")
    with pytest.raises(ValueError, match="input file"):
        jobs.run_key_summary_job(spark, str(inside), str(tmp_path), DAY)


def test_sales_job_can_set_bad_lines_apart(spark, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"transaction_id": "t1", "total_amount": 3.5, "region": "N"}\nnot json\n'
    )
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    counts = jobs.run_sales_job(spark, str(tmp_path / "in.json"), out, quarantine=bad)
    assert one(counts)["total_records"] == 1
    assert rows(spark.read.text(bad)) == [("not json",)]


def test_daily_job_refuses_an_empty_input(spark, tmp_path):
    path = tmp_path / "in" / f"sales_{DAY}.csv"
    path.parent.mkdir()
    path.write_text(",".join(schemas.SALES.fieldNames()) + "\n")
    with pytest.raises(ValueError, match="no rows"):
        jobs.run_daily_job(spark, str(path.parent), str(tmp_path / "out"), DAY)
    assert not (tmp_path / "out").exists()


def test_jobs_parse_once_and_leave_nothing_behind(spark, tmp_path):
    scratch = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.iterdir()) if scratch.exists() else set()
    reads = spark.sparkContext.accumulator(0)
    generators.metrics(spark.range(50)).write.csv(str(tmp_path / "m"), header=True)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    raw = spark.read.csv(str(tmp_path / "m"), header=True, schema=schemas.METRICS)
    jobs.run_metrics_job(raw.mapInPandas(counted, raw.schema), str(tmp_path / "out"), DAY)
    assert reads.value == 50
    assert set(scratch.iterdir()) == before


def test_clean_job(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("name,n,x\na,1,1.5\n,,\nb,,2.5\n,3,\n")
    moment = dt.datetime(2024, 1, 2, 3, 4, 5)
    summary = jobs.run_clean_job(
        spark, str(source), str(tmp_path / "data"), str(tmp_path / "stats"), moment
    )
    assert one(summary.drop("processing_timestamp")) == {
        "total_rows": 3, "total_columns": 5, "numeric_columns": 2,
    }
    data = spark.read.option("header", True).csv(str(tmp_path / "data"))
    assert sorted(rows(data.select("name", "n", "x"))) == [
        ("Unknown", "3", "1.5"), ("a", "1", "1.5"), ("b", "1", "2.5"),
    ]
    assert {r[0] for r in rows(data.select("processing_date"))} == {"2024-01-02"}
    stats = spark.read.option("header", True).csv(str(tmp_path / "stats")).first()
    assert (stats.n_count, stats.x_max) == ("3", "2.5")
    with pytest.raises(ValueError, match="overlap"):
        jobs.run_clean_job(spark, str(source), str(tmp_path / "d"), str(tmp_path / "d"))


def test_daily_job(spark, tmp_path):
    made = generators.random_sales(spark.range(300))
    one_file(made, tmp_path / "in" / f"sales_{DAY}.csv", "csv")
    summary = one(jobs.run_daily_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), DAY))
    assert summary["total_records_processed"] == 300 and summary["regions_covered"] == 4
    by_region = spark.read.option("header", True).csv(str(tmp_path / "out" / "sales-by-region"))
    assert by_region.count() == 4
    assert {str(r.processing_date) for r in by_region.collect()} == {DAY}


def test_channel_job(spark, tmp_path):
    made = generators.random_sales_ext(spark.range(500), DAY)
    one_file(made, tmp_path / "in" / f"sales_{DAY}.json")
    out = tmp_path / "out"
    jobs.run_channel_job(spark, str(tmp_path / "in"), str(out), DAY)
    segments = spark.read.json(str(out / "segment-analysis" / DAY))
    assert {r.customer_segment for r in segments.collect()} == set(generators.SEGMENTS)
    assert {"total_revenue", "customer_count", "avg_customer_value"} <= set(segments.columns)
    summary = document(out / "executive-summary" / DAY)
    assert summary["total_records_processed"] == 500
    regions = spark.read.json(str(out / "region-analysis" / DAY)).collect()
    assert summary["top_region"] == max(regions, key=lambda r: r.total_revenue).region


def test_simple_job(spark, tmp_path):
    made = generators.simple_sales(spark.range(100), DAY)
    one_file(made, tmp_path / "in" / f"sales_{DAY}.json")
    summary = jobs.run_simple_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), DAY)
    found = {(r.kind, r.key): r.value for r in summary.collect()}
    assert found["total", "total_revenue"] == 28225.0
    assert found["region_breakdown", "West"] == 7262.5
    assert found["top_customers", "CUST_049"] == 834.0
    assert sum(kind == "top_customers" for kind, _ in found) == 5


def test_key_summary_job(spark, tmp_path):
    made = generators.simple_sales_cat(spark.range(1000), DAY)
    one_file(made, tmp_path / "in" / f"sales_{DAY}.json")
    jobs.run_key_summary_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), DAY)
    back = spark.read.json(str(tmp_path / "out" / "regional-summary" / DAY))
    assert {r.key: (r.total_amount, r["count"]) for r in back.collect()} == {
        "North": (313750.0, 250), "South": (314375.0, 250),
        "East": (315000.0, 250), "West": (315625.0, 250),
    }


def test_quality_job(spark, tmp_path):
    made = generators.inject_faults(generators.payments(spark.range(500), DAY)).drop("id")
    jobs.run_quality_job(made, str(tmp_path), DAY)
    assert document(tmp_path / DAY)["overall_status"] == "FAILED"


def test_ingest_job(spark, tmp_path):
    found = {(r.kind, r.key): r.value for r in jobs.run_ingest_job(spark, str(tmp_path), DAY).collect()}
    assert found["total_records", "rows"] == 10000
    assert 60 <= found["missing_values", "amount"] <= 140
    known = sum(n for (kind, _), n in found.items() if kind == "categories")
    assert known == 10000 - found["missing_values", "category"]


def test_analysis_job(spark, tmp_path):
    source, out = str(tmp_path / "demo"), str(tmp_path / "out")
    everything = one(jobs.run_analysis_job(spark, source, out, "2025-07-24"))
    north = one(jobs.run_analysis_job(spark, source, out, "2025-07-25", "North"))
    assert 0 < north["records_processed"] < everything["records_processed"]
    products = spark.read.option("header", True).csv(out + "/product_analysis")
    assert products.filter("run_date = '2025-07-25'").count() == 5


def test_incremental_key_summaries(spark, tmp_path):
    landing = tmp_path / "landing"
    partials, progress = str(tmp_path / "partials"), str(tmp_path / "progress")
    keys = {"region": "region", "category": "category"}
    arrivals = []

    def arrive(made, name):
        one_file(made, landing / name)
        arrivals.append(made)
        collect_key_summaries(
            spark, str(landing), partials, progress, schemas.SIMPLE_SALES_CAT, keys
        )
        return spark.read.parquet(partials)

    def per_date(found):
        regions = merged_key_summaries(found).filter("summary = 'region'")
        return {r[0]: r[1] for r in rows(regions.groupBy("date").agg(F.sum("count")))}

    first = arrive(generators.simple_sales_cat(spark.range(40), DAY), "a.json")
    assert per_date(first) == {DAY: 40}
    arrive(generators.simple_sales_cat(spark.range(8), "2024-01-02"), "b.json")
    last = arrive(generators.simple_sales_cat(spark.range(4), DAY), "late.json")
    assert per_date(last) == {DAY: 44, "2024-01-02": 8}
    everything = arrivals[0].unionByName(arrivals[1]).unionByName(arrivals[2])
    columns = ["summary", "key", "total_amount", "count", "average_amount"]
    expected = summaries.grouped_key_summaries(everything, keys).select(columns)
    assert sorted(rows(merged_key_summaries(last, []).select(columns))) == sorted(rows(expected))


def test_metrics_job(spark, tmp_path):
    made = generators.metrics(spark.range(1000))
    summary = one(jobs.run_metrics_job(made, str(tmp_path), DAY))
    assert summary["total_records"] == 1000 and summary["categories"] == 4
    table = spark.read.option("header", True).csv(str(tmp_path / "histogram"))
    assert table.count() == 30
    assert {p.name for p in tmp_path.iterdir()} == {
        "describe", "category_stats", "box_stats", "histogram", "value_counts", "summary_metrics",
    }


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "payments")
    main(["ingest", out, DAY])
    main(["quality", f"{out}/{DAY}", str(tmp_path / "reports"), DAY])
    assert document(tmp_path / "reports" / DAY)["total_records"] == 10000
    assert "overall_status" in capsys.readouterr().out
    args = arguments().parse_args(["analysis", "in", "out", DAY, "--region", "North"])
    assert (args.job, args.region) == ("analysis", "North")
    with pytest.raises(SystemExit):
        arguments().parse_args(["sales", "in"])
