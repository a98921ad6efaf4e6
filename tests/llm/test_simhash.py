"""SimHash: fingerprints, keys and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from llm import edge
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from ledgerline.llm.common import table
from ledgerline.llm.components import components


def slow_print(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints):
    """Smallest member of each one's component over links of at most four bits."""
    values = np.array(prints, dtype=np.int64)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    close = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)) <= 4
    for i, j in zip(*np.nonzero(close), strict=True):
        a, b = find(prints[i]), find(prints[j])
        root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", [t or "" for t in edge.texts()])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == simhash.fingerprint(text, chunk=7) == slow_print(text)


def test_hash_is_the_engines(spark):
    (row,) = spark.createDataFrame([("a b ü d",)], "t string").select(F.xxhash64("t")).collect()
    assert row[0] % 2**64 == xxhash.xxh64_intdigest("a b ü d".encode(), 42)


def test_code_is_perfect():
    golay = simhash.Golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    codewords = np.array([m << 11 | golay.of_message[m] for m in range(4096)])
    distance = np.bitwise_count(words[:, None] ^ codewords[None, :])
    assert (distance.min(axis=1) <= 3).all() and ((distance <= 3).sum(axis=1) == 1).all()
    for near, d in zip(golay.near(words), distance, strict=True):
        assert near[0] == d.argmin()
        assert set(near[near >= 0]) == set(np.flatnonzero(d <= 4))


def test_pairs_up_to_four_bits_share_a_key():
    draw = random.Random(2)
    for trial in range(3_000):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), trial % 5):
            b ^= 1 << bit
        filed, looked = [
            set(np.concatenate([k[e] for k, e, *use in simhash._keys(np.array([x], dtype=np.uint64).view(np.int64)) if use[side]]))
            for x, side in ((a, 0), (b, 1))
        ]
        assert filed & looked


def clustered(seed, n):
    """Fingerprints with dense groups, chains and strangers."""
    draw = random.Random(seed)
    found = {0}
    while len(found) < n:
        center = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 3, 60])):
            value = center
            for bit in draw.sample(range(64), draw.randint(0, 5)):
                value ^= 1 << bit
            found.add(value)
            center = value if draw.random() < 0.2 else center
    return [v - 2**64 if v >= 2**63 else v for v in found]


@pytest.mark.parametrize("few", [64, 1])
def test_links_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    prints = clustered(few, 700)
    frame = spark.createDataFrame([(p,) for p in prints * 2] + [(None,)], "fingerprint bigint")
    found = {r.fingerprint: r.root for r in simhash.link(frame).collect()}
    assert found == slow_roots(prints)


def test_a_dense_group_gives_few_pairs(spark):
    """All fingerprints within two bits of one: links would be a pair of nearly all."""
    center = 0x0123456789ABCDEF
    prints = [center ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint bigint")
    found = simhash.link(frame).collect()
    assert len(found) == len(prints) and {r.root for r in found} == {min(prints)}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 400)] + [(7, 7), (None, 1)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.member: r.root for r in components(frame, "a", "b").collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 400)]}


def test_table(spark, folder):
    docs = table(spark, folder, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    signed = {i: p - 2**64 if p >= 2**63 else p for i, p in prints.items()}
    roots = slow_roots(sorted(set(signed.values())))
    least = {}
    for i, p in signed.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == least[roots[signed[r.doc_id]]]


def test_odd_rows(spark):
    docs = edge.docs(spark)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(edge.rows())
    groups = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    assert groups[3, "0" * 16] == groups[2, "0" * 16] == groups[None, "0" * 16] == 2
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    components_ = {(r.component_id, r.fingerprint if r.component_id is None else "") for r in found}
    assert len(kept) == len(components_) and {r.doc_id for r in kept} == {c for c, _ in components_}
    assert {r.text for r in kept} <= {r[1] for r in edge.rows()}
    assert simhash.near_duplicates(edge.empty(spark)).collect() == []
    assert simhash.one_of_each(edge.empty(spark)).collect() == []
