import math
from decimal import Decimal

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import quantiles
from ledgerline.functions.quantiles import exact_quantiles, order_code

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def frame(spark, groups):
    data = [(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs]
    return spark.createDataFrame(data, "k string, v double")


@pytest.fixture(params=["usual", "no broadcast"])
def rounds(request, spark):
    if request.param == "no broadcast":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_against_numpy(spark, rounds):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(100, 15, 501),
        "heavy tail": np.exp(rng.normal(0, 40, 400)),
        "negative": -rng.random(77) * 1e-3,
        "ties": rng.integers(0, 3, 300).astype(float),
        "hot": np.array([5.0] * 900 + [1.0, 9.0]),
        "single": np.array([42.0]),
        "pair": np.array([1.0, 2.0]),
        "huge": np.array([-1e308, 1e308, 3.0, 4.0]),
    }
    found = exact_quantiles(frame(spark, groups), "v", QUARTILES, ["k"])
    result = {r[0]: r[1:] for r in rows(found)}
    assert set(result) == set(groups)
    for name, values in groups.items():
        expected = np.quantile(values, list(QUARTILES.values()))
        assert result[name] == pytest.approx(tuple(expected), rel=1e-12), name


def test_lowest_value_rule(spark, rounds):
    groups = {"even": [4, 1, 3, 2], "odd": [5, 1, 9], "ties": [2, 2, 2, 7]}
    found = exact_quantiles(
        frame(spark, groups), "v", {"median": 0.5}, ["k"], interpolate=False
    )
    assert dict(rows(found)) == {"even": 2.0, "odd": 5.0, "ties": 2.0}


def test_null_and_nan_are_skipped_and_a_missing_key_is_a_group(spark):
    data = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), (None, 8.0), ("b", None)]
    df = spark.createDataFrame(data, "k string, v double")
    assert dict(rows(exact_quantiles(df, "v", {"m": 0.5}, ["k"]))) == {"a": 2.0, None: 8.0}
    assert rows(exact_quantiles(df, "v", {"m": 0.5})) == [(3.0,)]


def test_no_values_give_no_row(spark):
    assert rows(exact_quantiles(frame(spark, {"a": [None]}), "v", QUARTILES)) == []


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    values=st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1),
    p=st.floats(0, 1),
)
def test_any_doubles(spark, values, p):
    ((found,),) = rows(exact_quantiles(frame(spark, {"": values}), "v", {"q": p}))
    assert found == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-30)


def test_the_code_never_decreases(spark):
    rng = np.random.default_rng(2)
    values = sorted(
        [-math.inf, math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]
        + list(rng.normal(0, 1, 500)) + list(np.exp(rng.normal(0, 200, 500)))
        + [float(np.nextafter(2.0**e, d)) for e in range(-5, 60) for d in (-np.inf, np.inf)]
    )
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    codes = [r[0] for r in df.orderBy("i").select(order_code(F.col("v"))).collect()]
    assert codes == sorted(codes)
    assert 0 <= codes[0] and codes[-1] < quantiles.PARTS


def median_of(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    ((found,),) = rows(exact_quantiles(df, "v", {"m": 0.5}, interpolate=False))
    return found


def test_values_keep_their_type(spark):
    big = 2**53
    whole = [big + i for i in (1, 5, 7, 3, 9)]
    assert median_of(spark, whole, "bigint") == big + 5
    assert median_of(spark, [2**63 - 1, -(2**63), 2**63 - 3], "bigint") == 2**63 - 3
    money = [Decimal("12345678901234567890.12") + i for i in range(5)]
    assert median_of(spark, money, "decimal(30,2)") == money[2]
    widest = [Decimal(10**37 + i) for i in range(9)]
    assert median_of(spark, widest, "decimal(38,0)") == widest[4]
    assert median_of(spark, [3, 1, 2], "int") == 2


def test_infinite_values(spark):
    inf = math.inf
    for values in ([-inf, 1.0, 2.0, 3.0, inf], [-inf, -inf, 5.0], [1e308, -1e308, inf, 4.0, 5.0]):
        assert median_of(spark, values, "double") == sorted(values)[(len(values) - 1) // 2]


def test_the_scale_of_the_values_does_not_matter(spark):
    """Values that share a leading code are told apart within a few rounds."""
    made = spark.range(100_000).selectExpr("pmod(id * 7919, 100003) * 1e-20 as v")
    wanted = np.sort((np.arange(100_000) * 7919 % 100003) * 1e-20)
    found = exact_quantiles(made, "v", QUARTILES).first()
    assert tuple(found) == pytest.approx(tuple(np.quantile(wanted, [0.25, 0.5, 0.75])), rel=1e-12)
    plan = exact_quantiles(made, "v", QUARTILES)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_many_groups(spark):
    df = spark.range(20000).selectExpr("id % 1500 as k", "pmod(id * 7919, 10007) / 10.0 as v")
    ours = exact_quantiles(df, "v", QUARTILES, ["k"])
    theirs = df.groupBy("k").agg(
        *[F.percentile("v", F.lit(p)).alias(name) for name, p in QUARTILES.items()]
    )
    wanted = {r[0]: r[1:] for r in rows(theirs)}
    found = {r[0]: r[1:] for r in rows(ours)}
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)
