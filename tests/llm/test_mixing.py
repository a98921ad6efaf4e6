"""Mixing: targets, the cheapest flow and the selection."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import product

import pytest
from llm import edge
from pyspark.sql import functions as F

from ledgerline.llm import mixing
from ledgerline.llm.common import table


def test_weights_by_code_point():
    assert mixing.default_weights(["b", None, "B", "é"]) == {"B": 1, "b": 2, "é": 3, None: 1}


def test_targets_stop_at_three_times_and_share_the_rest():
    sizes = {"a": 10, "b": 100, "c": 1000}
    found = mixing.targets(sizes, {"a": 1, "b": 2, "c": 3}, 1110)
    assert found == {"a": 30, "b": 300, "c": 780}
    assert mixing.targets({"a": 0}, {"a": 1}, 0) == {"a": 0}
    assert mixing.targets({}, {}, 0) == {}


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_cheapest(seed):
    """Against all ways to take whole words of small patterns."""
    draw = random.Random(seed)
    patterns = {p: draw.randint(0, 3) for p in [("a",), ("b",), ("a", "b")]}
    quotas = {"a": draw.randint(0, 6), "b": draw.randint(0, 6)}
    taken = mixing.route(patterns, quotas)

    def cost(n, size):
        return sum(use * min(max(n - use * size, 0), size) for use in range(3))

    best = None
    for a, b, both in product(*(range(3 * patterns[p] + 1) for p in patterns)):
        if a > quotas["a"] or b > quotas["b"] or both > quotas["a"] + quotas["b"] - a - b:
            continue
        value = (-(a + b + both), sum(map(cost, (a, b, both), patterns.values())))
        best = value if best is None else min(best, value)
    own = (-sum(taken.values()), sum(cost(taken[p], n) for p, n in patterns.items()))
    assert own == best


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: (r.text or "", r.source) for r in docs.collect()}
    mixed = mixing.mix(docs, F.array("source"))
    found = mixed.rows.collect()
    assert mixed.rows.columns == [*docs.columns, "size", "repeats"]
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in found:
        assert r.size == len(texts[r.doc_id][0].encode().split()) and 0 <= r.repeats <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.repeats
        largest[r.source] = max(largest[r.source], r.size)
    assert mixed.sizes == sizes
    weights = mixing.default_weights(list(sizes))
    level = Fraction(sum(sizes.values()), sum(weights.values()))
    for s, target in mixed.targets.items():
        if level * max(weights.values()) <= 3 * min(sizes.values()):
            assert target == pytest.approx(float(level * weights[s]))
        assert abs(taken[s] - target) <= max(0.01 * target, largest[s] / 2)
    again = mixing.mix(docs, F.array("source")).rows.collect()
    assert {(r.doc_id, r.repeats) for r in again} == {(r.doc_id, r.repeats) for r in found}


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)]
    rows += [(1000, "w", []), (1001, "w", None), (1002, "w w", [None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tags array<string>")
    mixed = mixing.mix(docs, F.col("tags"), {"a": 1, "b": 1, None: 0})
    by_pattern = defaultdict(int)
    for r in mixed.rows.collect():
        by_pattern[str(r.tags)] += r.size * r.repeats
    assert mixed.sizes == {"a": 1000, "b": 500, None: 2}
    assert by_pattern["['a']"] + by_pattern["['a', 'b']"] == 1000  # nothing twice but what must be
    assert by_pattern["[]"] == by_pattern["None"] == by_pattern["[None]"] == 0


def test_many_equal_rows_are_cut_exactly(spark):
    """A third and more of a source is one row over and over: as many copies are taken as fit."""
    rows = [(7, "a b c", "s")] * 3000 + [(i, "w " * 50, "t") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    mixed = mixing.mix(docs, F.array("source"))
    taken = mixed.rows.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats"))).collect()
    for source, n in taken:
        assert abs(n - mixed.targets[source]) <= 50


def test_odd_rows(spark):
    docs = edge.docs(spark)
    with pytest.raises(ValueError):
        mixing.mix(docs, F.array("source"))  # "size" is a column already
    mixed = mixing.mix(docs, F.array("source"), names={"size": "n_words"})
    found = mixed.rows.collect()
    assert mixed.rows.columns == [*docs.columns, "n_words", "repeats"]
    assert len(found) == len(edge.rows()) and all(0 <= r.repeats <= 3 for r in found)
    assert sorted(r.n_words for r in found) == sorted(
        len((t or "").encode().split()) for _, t, *_ in edge.rows()
    )
    none = mixing.mix(edge.empty(spark), F.array("source"), names={"size": "n"})
    assert none.rows.collect() == [] and none.targets == {}
