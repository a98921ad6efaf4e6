"""Partials per run, counters taken while writing, files by hidden metadata, samples by key."""

import random

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from ledgerline.operators import cleaning, quality, rollups, summaries
from ledgerline.operators.observed import completeness, counted
from ledgerline.plans import jobs
from ledgerline.plans.queries import line_numbers
from ledgerline.session import materialize
from ledgerline.sources import files, generators
from ledgerline.sources.sales import FlatSales, StarSales

EDGE = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**40, -(2**40), 65536, None, 0, 1]


def counts(sets, *by):
    return {r.name: (r.known, r.missing) for r in rollups.distinct_counts(sets, *by).collect()}


def test_bitmaps_tell_all_values_apart(spark):
    df = spark.createDataFrame([(v, None if v is None else str(v)) for v in EDGE], "a bigint, b string")
    df = df.withColumn("c", F.lit(None).cast("int"))
    sets = rollups.key_sets(df, F.lit("r"), ["a", "b", "c"])
    different = len({v for v in EDGE if v is not None})
    assert counts(sets) == {"a": (different, True), "b": (different, True), "c": (0, True)}


@pytest.mark.parametrize("seed", range(3))
def test_merged_sets_count_like_sets(spark, seed):
    draw = random.Random(seed)
    data = [(draw.randint(1, 4), draw.choice([None, *range(-70000, 70000, 977)]), draw.choice("xyz"))
            for _ in range(400)]
    df = spark.createDataFrame(data, "run int, id int, `odd name.` string")
    sets = materialize(rollups.key_sets(df, F.col("run"), ["id", "odd name."]))
    for chosen in ({1}, {1, 3}, {1, 2, 3, 4}):
        merged = counts(sets.filter(F.col("run").isin(*chosen)))
        ids = {i for r, i, _ in data if r in chosen}
        assert merged["id"] == (len(ids - {None}), None in ids)
        assert merged["odd name."] == (len({w for r, _, w in data if r in chosen}), False)


def test_final_counts_from_runs_without_the_lines(spark, folder, tmp_path):
    path = str(tmp_path / "facts")
    star = StarSales(spark, folder)
    rollups.write_run_facts(star, path, F.date_format("transaction_date", "yyyy"))
    facts = rollups.RunFacts.read(spark, path)
    merged = facts.final_counts()
    assert all(str(tmp_path) in f for f in merged.inputFiles())
    assert one(merged) == one(summaries.final_counts(star))
    year = facts.where(F.col("run") == "1995")
    plan = year.keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan
    only = star.rows("transaction_id", "transaction_date", "customer_id", "product_id", "region",
                     "product_category", "quantity", "total_amount")
    only = only.filter(F.year("transaction_date") == 1995)
    assert one(year.final_counts()) == one(summaries.final_counts(FlatSales(only)))


def test_a_run_written_again_replaces_itself(spark, tmp_path):
    path, run = str(tmp_path / "facts"), F.col("transaction_date")
    sales = generators.sales(spark.range(50), "2024-01-01")
    rollups.write_run_facts(FlatSales(sales), path, run)
    other = generators.sales(spark.range(30), "2024-01-02").withColumn("region", F.lit(None).cast("string"))
    rollups.write_run_facts(FlatSales(other), path, run)
    rollups.write_run_facts(FlatSales(other.limit(20)), path, run)
    found = one(rollups.RunFacts.read(spark, path).final_counts())
    assert (found["total_records"], found["unique_regions"], found["unique_customers"]) == (70, 5, 50)
    undated = other.withColumn("transaction_date", F.lit(None).cast("string"))
    rollups.write_run_facts(FlatSales(undated), path, run)
    facts = rollups.RunFacts.read(spark, path)
    assert rows(facts.totals.select("run", "rows").orderBy("run")) == [
        ("2024-01-01", 50), ("2024-01-02", 20), ("undated", 30)
    ]


def test_facts_of_no_rows(spark, tmp_path):
    sales = generators.sales(spark.range(5), "2024-01-01")
    path = str(tmp_path / "facts")
    rollups.write_run_facts(FlatSales(sales), path, F.col("transaction_date"))
    nothing = rollups.RunFacts.read(spark, path).where(F.lit(False))
    assert one(nothing.final_counts()) == {
        "total_records": 0, "total_revenue": None, "unique_customers": 0, "unique_products": 0,
        "unique_regions": 0, "unique_categories": 0,
    }


def test_merged_sketches_keep_their_rank_error(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 7).alias("run"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7919 % 10_007).cast("int").alias("whole"),
        F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.exp(F.col("id") / 9000.0)).alias("real"),
        (F.col("id").cast("decimal(12,2)") / 4).cast("decimal(12,2)").alias("money"),
        F.lit(None).cast("bigint").alias("nothing"),
    )
    names = ["whole", "real", "money", "nothing"]
    sketches = materialize(rollups.value_sketches(df, F.col("run"), names))
    wanted = {"low": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "high": 0.99}
    merged = rollups.merged_quantiles(sketches, wanted)
    sizes = {r.name: r["values"] for r in merged.collect()}
    assert sizes == {"whole": 60_000, "real": 54_545, "money": 60_000}
    near = rollups.ranks_within(df, materialize(merged), wanted, 0.01).collect()
    assert len(near) == 15 and all(r.within for r in near)
    by_run = rollups.merged_quantiles(sketches, {"median": 0.5}, "run")
    assert by_run.count() == 21
    wrong = merged.withColumn("median", F.col("median") * 1.5)
    assert not all(r.within for r in rollups.ranks_within(df, wrong, {"median": 0.5}, 0.01).collect())


def jobs_of(spark, action):
    group = f"count {random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("tests", "")


def test_counters_cost_no_job(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 2.0, "a"), (None, float("nan"), "b"), (3, 4.5, None)], "a int, b double, c string"
    )
    held = []

    def plain():
        df.write.parquet(str(tmp_path / "plain"))

    def watched():
        frame, counters = counted(df, rejected=F.col("c") == "a", amount="b")
        frame.write.parquet(str(tmp_path / "watched"))
        held.append((counters.rows, counters.rejected, counters.missing, counters.total))

    assert jobs_of(spark, plain) == jobs_of(spark, watched)
    assert held == [(3, 1, {"a": 1, "b": 1, "c": 1}, 4.5)]


def test_completeness_from_counters(spark, tmp_path):
    df = spark.range(500).select(
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("customer_id"),
        F.when(F.col("id") % 9 != 0, 1.5).alias("amount"), F.lit("Food").alias("category"),
        F.lit("Cash").alias("payment_method"),
    )
    frame, counters = counted(df)
    frame.write.parquet(str(tmp_path / "p"))
    written = spark.read.parquet(str(tmp_path / "p"))
    assert rows(completeness(df, counters)) == rows(quality.completeness(written))


def test_jobs_count_while_they_stage(spark, tmp_path):
    source = tmp_path / "in.json"
    source.write_text('{"transaction_id": "t1", "total_amount": 3.5}\nnot json\n{"quantity": "x"}\n')
    seen = []
    jobs.run_sales_job(spark, str(source), str(tmp_path / "out"), str(tmp_path / "bad"), seen)
    assert (seen[0].rows, seen[0].rejected, seen[0].missing["total_amount"]) == (3, 2, 2)
    source.write_text("")
    with pytest.raises(ValueError, match="no rows"):
        jobs.run_sales_job(spark, str(source), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    (tmp_path / "in.csv").write_text("a,b\n1,x\n,\n,y\n")
    clean = (str(tmp_path / "in.csv"), str(tmp_path / "data"), str(tmp_path / "stats"))
    jobs.run_clean_job(spark, *clean, seen=seen)
    assert (seen[1].rows, seen[1].rejected, seen[1].missing) == (3, 1, {"a": 2, "b": 1})
    (tmp_path / "in.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        jobs.run_clean_job(spark, *clean)


def test_file_contents(spark, tmp_path):
    path = str(tmp_path / "runs")
    made = spark.range(100).withColumn("run", F.concat(F.lit("r"), F.col("id") % 3))
    made.repartition(2).write.partitionBy("run").parquet(path)
    found = files.file_contents(spark.read.parquet(path), "id", "run")
    listed = files.file_inventory(spark, path)

    def facts(frame):
        return {r.path.split("runs/")[1]: (r.size, r.last_modified) for r in frame.collect()}

    assert facts(found) == facts(listed)
    assert found.filter("not gapless").count() == 0
    part = files.file_contents(spark.read.parquet(path).filter("id >= 50"), "id")
    assert one(part.agg(F.sum("rows").alias("n"), F.min("least").alias("g"))) == {"n": 50, "g": 50}
    assert part.filter("gapless").count() == 0
    expected = spark.createDataFrame([("r0",), ("r1",), ("r9",), ("r9",)], "run string")
    runs = {r.run: r for r in files.run_contents(found, expected, "run").collect()}
    assert {k: (r.expected, r.exists, r.rows, r.least) for k, r in runs.items()} == {
        "r0": (True, True, 34, 0), "r1": (True, True, 33, 1), "r2": (False, True, 33, 2),
        "r9": (True, False, 0, None),
    }


def test_file_contents_of_text(spark, tmp_path):
    spark.range(20).repartition(3).write.json(str(tmp_path / "j"))
    found = files.file_contents(spark.read.json(str(tmp_path / "j")), "id")
    assert one(found.agg(F.sum("rows").alias("n"), F.count("gapless").alias("w"))) == {"n": 20, "w": 0}


def test_samples_do_not_depend_on_partitions(spark, folder):
    lines = line_numbers(spark, folder).withColumn("k", F.xxhash64("*"))
    def chosen(df):
        return sorted(rows(cleaning.sample_fraction(df, ["k"], 0.1).select("k")))
    assert chosen(lines) == chosen(lines.repartition(5, "l_tax")) == chosen(lines.orderBy(F.desc("k")))
    assert chosen(lines) != sorted(rows(cleaning.sample_fraction(lines, ["k"], 0.1, 7).select("k")))
    assert abs(len(chosen(lines)) / lines.count() - 0.1) < 0.02
    exact = cleaning.sample_rows(lines, ["k"], 40)
    assert exact.count() == 40 and exact.columns == lines.columns
    assert sorted(rows(exact.select("k"))) == sorted(rows(cleaning.sample_rows(lines.repartition(3), ["k"], 40).select("k")))
    points = cleaning.scatter_points(lines, "l_tax", "l_discount", 0.5)
    assert 0 < points.count() < lines.count()
    assert cleaning.sample_rows(lines.limit(3), ["k"], 40).count() == 3
