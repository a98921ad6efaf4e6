"""The stages one after another, each against what it must keep; queries with SQL."""

import re
from collections import Counter

import duckdb
import pytest
from llm import edge

import corpus_pipeline
from ledgerline.llm import common, queries, simhash
from ledgerline.llm.common import table
from ledgerline.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, folder):
    """What each stage gets and returns, over the small tables."""
    docs = table(spark, folder, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], folder)))
    return [f.collect() for f in frames], [f.columns for f in frames]


def test_columns_stay(kept):
    _, columns = kept
    assert all(c == COLUMNS for c in columns[:-1])


def test_stages(kept, spark, folder):
    start, clean, cut, single, mixed, packed = kept[0]
    assert 0.5 * len(start) < len(clean) <= len(start)
    assert Counter(r.doc_id for r in cut) == Counter(r.doc_id for r in clean)
    assert all(r.n_chars == len(r.text or "") for r in cut)
    prints = {simhash.fingerprint(r.text or "") for r in cut}
    assert len(single) <= len(prints) and {r.doc_id for r in single} <= {r.doc_id for r in cut}
    left = [simhash.fingerprint(r.text or "") for r in single]
    assert min(((a ^ b).bit_count() for i, a in enumerate(left) for b in left[:i]), default=5) > 4
    uses = Counter(r.doc_id for r in mixed)
    assert set(uses) <= {r.doc_id for r in single} and max(uses.values()) <= 3
    whole = {r.doc_id: r.doc_tokens for r in packed}
    assert set(whole) == set(uses)
    assert sum(r.length for r in packed) == sum(n * whole[i] for i, n in uses.items())


def test_run_is_the_stages(kept, spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == kept[1][-1]
    wanted = Counter((r.doc_id, r.start, r.doc_tokens) for r in kept[0][-1] if r.start == 0)
    assert Counter((r.doc_id, r.start, r.doc_tokens) for r in found.collect() if r.start == 0) == wanted


def test_stages_handle_odd_rows(spark, folder):
    docs = edge.docs(spark).drop("score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[: len(COLUMNS)] == COLUMNS, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
    docs = edge.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_agree_with_sql(spark, folder, name):
    engine = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        engine.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    result = queries.QUERIES[name](spark, folder)
    expected = engine.sql(queries.ORACLE[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    picked = [expected.columns.index(c) for c in columns]
    wanted = Counter(tuple(row[i] for i in picked) for row in expected.fetchall())
    assert Counter(tuple(row[c] for c in columns) for row in result.collect()) == wanted


def test_native_operators_run_no_python(spark, folder):
    for name in ("op1_syncmers", "op4_line_dedup"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|MapInArrow|CartesianProduct|NestedLoop", plan)


def test_every_operator_has_a_query():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and common.WORD
