"""The trie against plain Python over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm import edge

from ledgerline.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]


def slow_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return found


def slow(rows):
    convs = slow_rebuilt(rows)
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        size = len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * size
    result = []
    for path, held in members.items():
        ends = sorted(c for c in held if len(convs[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        result.append(
            (min(held), len(path), parent, len(held), len(children[path]), leaves[path], saved[path], digest)
        )
    return sorted(map(str, result))


def found(frame):
    result = prefix_trie.described(frame)
    assert result.columns == COLUMNS
    return sorted(str(tuple(r)) for r in result.collect())


def conversations(seed, n, most, texts=3):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(2 * n), n):
        for t in range(draw.randint(1, most)):
            role = draw.choice(["user", "assistant", None, "u"])
            rows.append((c, t, role, draw.choice(["", "ä", "yes", None, "a b"][:texts])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, most, texts", [(0, 40, 4, 1), (1, 150, 12, 2), (2, 30, 40, 3)])
def test_like_plain_python(spark, seed, n, most, texts):
    rows = conversations(seed, n, most, texts)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == slow(rows)


def test_one_conversation_and_one_first_turn_hold_most_rows(spark):
    rows = [(10, t, "user", f"turn {t}") for t in range(300)]
    rows += [(c, t, "user", "hello") for c in range(100, 700) for t in range(2)]
    rows += [(c, 0, "user", "hello") for c in range(5000, 7000)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == slow(rows)


def test_ties_nulls_and_turnless(spark):
    rows = [
        (0, None, "b", "x"), (0, None, "a", "x"), (0, 5, None, None), (0, 5, None, None),
        (1, 2, "r", "t"), (7, 0, "r", ""), (7, 1, "", "r"), (7, 1, "r", None), (None, 1, "r", "t"),
        (2**40, 3, "r", "\U0001f600"), (3, -1, "r", "t"), (3, 0, "r", "long " * 30_000),
        (8, 0, "ab", "c"), (9, 0, "a", "bc"), (33, 1, "r", "t"),
    ]
    rows += [(c, 0, "r", "t") for c in range(2000, 2040)]  # some end before their own first turn
    assert any(not turns for turns in slow_rebuilt(rows).values())
    assert found(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_other_columns_and_kinds_of_ids(spark):
    from pyspark.sql import functions as F

    rows = conversations(5, 20, 5)
    names = [*edge.CLASHING, "depth", "part", "line", "rows", "before", "segment", "digest", "s1"]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in names})
    assert found(frame.withColumn("conv_id", F.col("conv_id").cast("int"))) == slow(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert found(frame) == []
    assert found(spark.createDataFrame([(None, 1, "r", "t")], SCHEMA)) == []


def test_digests_run_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 7)
    ends = spark.range(0, 1000, 1, 6).selectExpr(
        "cast(if(id % 3 = 0, 'a', 'b' || id % 5) as binary) as key", "id * 7919 % 10007 as conv_id"
    )
    held = defaultdict(list)
    for r in ends.collect():
        held[bytes(r.key)].append(r.conv_id)
    result = {bytes(r.key): r.ends_sha256 for r in prefix_trie.joined_digest(ends).collect()}
    assert result == {
        k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in held.items()
    }
