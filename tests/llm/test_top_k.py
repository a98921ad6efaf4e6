"""Exact top-k against sorting all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import top_k
from ledgerline.llm.common import table


def slow(rows, asks, k):
    """Rows of (query_id, rank, vec_id, score); a row is itself, whatever its id."""
    usable = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(64 * float(x)) for x in v]))
    found = []
    for at, (i, q) in enumerate(usable):
        if not asks(i):
            continue
        scores = [
            (-sum(a * b for a, b in zip(q, v, strict=True)), j)
            for other, (j, v) in enumerate(usable)
            if other != at and len(v) == len(q)
        ]
        found += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


def searched(frame, asks, k):
    return sorted(tuple(r) for r in top_k.top_k(frame, asks, k).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 90)
    monkeypatch.setattr(top_k, "BLOCK_QUERIES", 25)


def frame_of(spark, rows):
    schema = "vec_id bigint, embedding array<float>, rows string, shard int, kth int"
    return spark.createDataFrame([(i, v, "own", 1, 2) for i, v in rows], schema)


@pytest.mark.parametrize("kind", ["spread", "groups", "same", "coarse"])
def test_against_brute_force(spark, small, kind):
    random = np.random.default_rng(7)
    v = random.normal(0, 1, (400, 6))
    if kind == "groups":
        v = random.normal(0, 9, (8, 6))[random.integers(0, 8, 400)] + v / 20
    if kind == "same":
        v[random.random(400) < 0.6] = v[0]
    if kind == "coarse":
        v = np.round(v) / 64
    rows = [(i, [float(np.float32(x)) for x in w]) for i, w in enumerate(v)]
    asks = F.col("vec_id") % 5 == 0
    assert searched(frame_of(spark, rows), asks, 7) == slow(rows, lambda i: i % 5 == 0, 7)


def test_odd_rows(spark, small):
    rows = [(i, [i / 7, -i / 3]) for i in range(40)]
    rows += [(3, [0.5, 0.25])] * 3 + [(10, [0.5, 0.25])] * 2
    rows += [(50, None), (51, []), (52, [1.0, None]), (53, [float("nan"), 1.0])]
    rows += [(54, [float("inf"), 1.0]), (None, [1.0, 1.0]), (60, [1.0]), (70, [2.0]), (80, [1e30])]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 80]
    asks = F.col("vec_id") % 10 == 0
    assert searched(frame_of(spark, rows), asks, 5) == slow(rows, lambda i: i % 10 == 0, 5)
    assert searched(frame_of(spark, rows), F.lit(None).cast("boolean"), 5) == []
    assert searched(frame_of(spark, rows).limit(0), asks, 5) == []


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0**40 + 1, 3.0]])
    b = np.array([[2.0**20 + 1, 5.0]])
    assert top_k.products(a, b)[0, 0] == (2**40 + 1) * (2**20 + 1) + 15
    with pytest.raises(OverflowError):
        top_k.products(np.array([[1e30]]), np.array([[1e30]]))


def test_nodes_are_skipped():
    random = np.random.default_rng(3)
    v = np.floor(64 * (random.normal(0, 9, (20, 8))[random.integers(0, 20, 4000)] + random.normal(0, 0.1, (4000, 8))))
    tree = top_k.BallTree.build(v)
    seen = []
    original = top_k.products
    top_k.products = lambda a, b: seen.append(len(a) * len(b)) or original(a, b)
    try:
        rows = np.arange(4000)
        top_k.search(v, rows, rows, tree, v[:100], rows[:100], np.full(100, top_k.NEVER), 5)
    finally:
        top_k.products = original
    assert sum(seen) < 0.5 * 100 * 4000


def test_table(spark, folder):
    frame = table(spark, folder, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert searched(frame, F.col("vec_id") % 20 == 0, 20) == slow(rows, lambda i: i % 20 == 0, 20)
