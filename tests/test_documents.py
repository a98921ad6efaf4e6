"""Typed documents and descriptions in the columns' own types."""

import datetime as dt
import decimal
import random

import pytest
from conftest import rows

from ledgerline.operators import profiling
from ledgerline.sinks import documents


def test_typed_documents_keep_types_through_parquet(spark, tmp_path):
    frame = spark.createDataFrame(
        [(1, 2**60, 0.1, True, "x.y", None, dt.date(2024, 1, 2), [1, 2], {"k": "v"}, ({"n": 1},))],
        "a int, big bigint, d double, flag boolean, s string, gone string, day date, list array<int>, "
        "m map<string, string>, deep struct<m: map<string, int>>",
    )
    documents.typed_document(frame).write.parquet(str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.dtypes == [("value", "variant")]
    leaves = {r.path: (r.kind, r.text) for r in documents.document_leaves(back).collect()}
    assert leaves == {
        "a": ("BIGINT", "1"), "big": ("BIGINT", str(2**60)), "d": ("DOUBLE", "0.1"),
        "flag": ("BOOLEAN", "true"), "s": ("STRING", "x.y"), "gone": ("VOID", None),
        "day": ("DATE", "2024-01-02"), "list.0": ("BIGINT", "1"), "list.1": ("BIGINT", "2"),
        "m.k": ("STRING", "v"), "deep.m.n": ("BIGINT", "1"),
    }
    with pytest.raises(Exception, match="nested deeper than 2"):
        documents.document_leaves(back, depth=2).collect()


def test_leaves_of_several_documents_and_of_none(spark):
    frame = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    found = documents.document_leaves(documents.typed_document(frame))
    assert sorted(map(str, rows(found.select("path", "text")))) == ["('a', '1')", "('a', '2')", "('a', None)"]
    assert documents.document_leaves(documents.typed_document(frame.limit(0))).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_exact_descriptions(spark, seed):
    draw = random.Random(seed)
    n = draw.choice([1, 2, 7, 40])
    whole = [draw.choice([2**53 + 1, -(2**60), 5, 2**62 + draw.randint(0, 9)]) for _ in range(n)]
    money = [decimal.Decimal(draw.randint(-(10**20), 10**20)).scaleb(-2) for _ in range(n)]
    frame = spark.createDataFrame(
        [(a, b, None, float(a % 7)) for a, b in zip(whole, money, strict=True)] + [(None, None, None, float("nan"))],
        "whole bigint, money decimal(22,2), nothing int, real double",
    )
    found = {r.column: r for r in profiling.describe_exact(frame).collect()}

    def quartile(values, k):
        ordered = sorted(map(decimal.Decimal, values))
        at, rest = divmod((len(ordered) - 1) * k, 4)
        upper = ordered[min(at + 1, len(ordered) - 1)]
        with decimal.localcontext() as context:
            context.prec = 60
            return ordered[at] + (upper - ordered[at]) * rest / 4

    for name, values in (("whole", whole), ("money", money)):
        row = found[name]
        assert row["count"] == n
        assert [decimal.Decimal(row[c]) for c in ("min", "q25", "median", "q75", "max")] == [
            min(values), *(quartile(values, k) for k in (1, 2, 3)), max(values)
        ]
    assert found["nothing"]["count"] == 0 and found["nothing"].median is None
    assert found["real"]["count"] == n and float(found["real"].max) == max(a % 7 for a in whole)


def test_an_exact_description_of_text_is_empty(spark):
    assert profiling.describe_exact(spark.createDataFrame([("a",)], "s string")).collect() == []
