"""Operator 13: a trie of conversation prefixes with depth-band rollup.

A node is a distinct sequence of first turns. It is known by the sums, over its turns, of
four 32-bit parts of a SHA-256 of each turn with its position, so a conversation's nodes
follow from running sums, and its parents' from the same sums without the last turn.

Sums over subtrees go bottom-up by bands of depths. Within a band every node adds its own
numbers, and those that completed bands below handed to it, to itself and its ancestors in
the band, of which there are no more than the band is high; then the totals of the band's
topmost nodes go to their parents in the next band. Rounds are as many as bands, and no row
is copied more often than a band is high. The height grows with the root of the depth, so
both stay small for long conversations.

Neither a conversation nor a node is gathered in one task: turns are put in order by a range
shuffle and numbered by adding up counts per task, running sums go by segments of a
conversation, and members are counted before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.hot_join import left_join
from ledgerline.llm.numbering import numbered
from ledgerline.session import materialize

LANES = ["s1", "s2", "s3", "s4"]
LEAST_HEIGHT = 8
SEGMENT_BANDS = 64  # bands of one conversation that one window runs over
IDS_PER_CHUNK = 1 << 14


@dataclass(frozen=True)
class Trie:
    """`nodes`: key, parent_key, conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens. `ends`: key, conv_id of the node at which each
    conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def rebuilt(
    conversations: DataFrame,
    group: int = 5,
    borrowed: int = 9,
    id_column: str = "conv_id",
) -> DataFrame:
    """conv_id, depth (from 1), digest and n_bytes of every rebuilt conversation's turns, and
    depth 0 for every conversation.

    Conversation c takes the first h = crc32(c) % `borrowed` turns of conversation
    c - c % `group` (all if it has fewer, none if there is none) and its own after its first
    h. Turns are ordered by `turn`, nulls first, equal ones by role and text; a null role or
    text is empty; rows without a conversation take no part.
    """
    present = conversations.filter(conversations[id_column].isNotNull()).select(
        conversations[id_column].alias("conv_id"),
        conversations["turn"].alias("turn"),
        F.coalesce(conversations["role"], F.lit("")).alias("role"),
        F.coalesce(conversations["text"], F.lit("")).alias("text"),
    )
    # The role's length keeps role and text apart.
    turn = F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text"))
    digested = present.select(
        "conv_id", "turn", F.sha2(turn, 256).alias("digest"),
        F.octet_length("text").cast("bigint").alias("n_bytes"), "role", "text",
    )
    rows, parts = numbered(digested, "conv_id", ["turn", "role", "text"], ["digest", "n_bytes"])
    sizes = parts.groupBy("conv_id").agg(F.sum("rows").alias("rows"))
    base = F.col("conv_id") - F.col("conv_id") % group
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed
    plans = sizes.select("conv_id", base.alias("base"), head.alias("head"))
    lengths = sizes.select(F.col("conv_id").alias("base"), F.col("rows").alias("there"))
    taken = F.least("head", F.coalesce("there", F.lit(0)))
    plans = materialize(
        plans.join(lengths, "base", "left").select("conv_id", "base", "head", taken.alias("taken"))
    )
    place = parts.join(plans, "conv_id").select("conv_id", "part", "before", "head", "taken")
    placed = rows.join(place, ["conv_id", "part"]).withColumn("at", F.col("before") + F.col("at"))
    own = placed.filter(F.col("at") > F.col("head")).select(
        "conv_id", (F.col("at") - F.col("head") + F.col("taken")).alias("depth"), "digest", "n_bytes"
    )
    firsts = (
        rows.join(parts, ["conv_id", "part"])
        .filter((F.col("conv_id") % group == 0) & (F.col("before") + F.col("at") < borrowed))
        .select(F.col("conv_id").alias("base"), (F.col("before") + F.col("at")).alias("depth"),
                "digest", "n_bytes")
    )
    lent = (
        plans.select("conv_id", "base", "taken").join(firsts, "base")
        .filter(F.col("depth") <= F.col("taken")).select("conv_id", "depth", "digest", "n_bytes")
    )
    root = plans.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("digest"),
        F.lit(0).cast("bigint").alias("n_bytes"),
    )
    return own.unionByName(lent).unionByName(root)


def _key(depth: Column, sums: list[Column]) -> Column:
    """Sixteen bytes that stand for a sequence of `depth` turns."""
    text = F.concat_ws(",", *[c.cast("string") for c in (depth, *sums)])
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _steps(turns: DataFrame, height: int) -> DataFrame:
    """conv_id, depth, n_bytes, key, parent_key and line (the keys of the node and its ancestors
    in its band, topmost first) for each turn and root."""
    tagged = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    turns = turns.withColumn("tag", tagged)
    lanes = [
        F.when(F.col("depth") > 0, F.conv(F.substring("tag", 8 * i + 1, 8), 16, 10).cast("bigint"))
        .otherwise(0)
        .alias(name)
        for i, name in enumerate(LANES)
    ]
    segment = F.floor(F.col("depth") / (height * SEGMENT_BANDS)).alias("segment")
    turns = materialize(turns.select("conv_id", "depth", "n_bytes", segment, *lanes))
    sums = turns.groupBy("conv_id", "segment").agg(*[F.sum(c).alias(c) for c in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select("conv_id", "segment", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in LANES
    ])
    run = Window.partitionBy("conv_id", "segment").orderBy("depth")
    running = run.rowsBetween(Window.unboundedPreceding, 0)
    band = run.rowsBetween(1 - height, 0)
    depth = F.col("depth")
    totals = [F.col(f"{c}_before") + F.sum(c).over(running) for c in LANES]
    return (
        turns.join(offsets, ["conv_id", "segment"])
        .select("conv_id", "segment", "depth", "n_bytes", *LANES,
                *[t.alias(f"{c}_total") for t, c in zip(totals, LANES, strict=True)])
        .select(
            "conv_id", "segment", "depth", "n_bytes",
            _key(depth, [F.col(f"{c}_total") for c in LANES]).alias("key"),
            F.when(depth > 0, _key(depth - 1, [F.col(f"{c}_total") - F.col(c) for c in LANES]))
            .alias("parent_key"),
        )
        .withColumn("line", F.collect_list("key").over(band))
        .withColumn("line", F.slice(
            "line", (F.size("line") - depth % height).cast("int"), (depth % height + 1).cast("int")
        ))
    )


def _rolled_up(nodes: DataFrame, height: int, deepest: int) -> DataFrame:
    """key, n_leaves, saved_tokens: sums over the subtree of every node. `nodes` has key,
    parent_key, depth, line, leaf and saved."""
    done: list[DataFrame] = []
    handed = None
    for band in range(deepest // height, -1, -1):
        here = nodes.filter(F.floor(F.col("depth") / height) == band)
        added = here.select("key", "parent_key", "depth", "line", "leaf", "saved")
        if handed is not None:
            added = added.join(handed, "key", "left").select(
                "line",
                (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("leaf"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            )
        totals = materialize(
            added.select(F.explode("line").alias("key"), "leaf", "saved")
            .groupBy("key")
            .agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        )
        done.append(totals)
        if band:
            tops = here.filter(F.col("depth") == band * height).select("key", "parent_key")
            handed = (
                tops.join(totals, "key")
                .groupBy(F.col("parent_key").alias("key"))
                .agg(
                    F.sum("n_leaves").alias("more_leaves"),
                    F.sum("saved_tokens").alias("more_saved"),
                )
            )
    result = done[0]
    for totals in done[1:]:
        result = result.unionByName(totals)
    return result


def trie(conversations: DataFrame, group: int = 5, borrowed: int = 9) -> Trie:
    """The trie of the rebuilt conversations (see `rebuilt`).

    Every conversation, also one without turns, is a member of the root, which has no text
    and no parent; an empty table has no nodes. saved_tokens sums, over a node's subtree, the
    UTF-8 bytes of each node's last text once for every member but one. Columns beside
    conv_id, turn, role and text are not read. Runs jobs when called: two for each band.
    """
    turns = materialize(rebuilt(conversations, group, borrowed))
    deepest = turns.agg(F.max("depth")).first()[0] or 0
    height = max(LEAST_HEIGHT, round(deepest**0.5))
    steps = materialize(_steps(turns, height))
    members = steps.groupBy("key", "parent_key", "depth", "n_bytes", "line").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    )
    members = materialize(members)
    children = members.filter(F.col("parent_key").isNotNull()).groupBy(
        F.col("parent_key").alias("key")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    counted = members.join(children, "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))
    )
    counted = materialize(counted)
    own = counted.select(
        "key", "parent_key", "depth", "line",
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    totals = _rolled_up(own, height, deepest)
    parents = counted.select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")
    )
    named = left_join(counted.drop("line", "n_bytes"), parents, ["parent_key"])
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "key"))["key"].alias("key"))
    return Trie(named.join(totals, "key"), last.select("key", "conv_id"))


def joined_digest(ends: DataFrame) -> DataFrame:
    """`key`, `ends_sha256`: lowercase SHA-256 of a key's conv_ids, ascending, decimal and joined
    by commas.

    A hash runs over its text in order, so one task reads a key's ids; it gets them in pieces
    of joined text made in parallel, each read and dropped in turn.
    """
    keys = ["key", "conv_id"]
    ordered = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = T.StructType(
        [
            T.StructField("key", T.BinaryType()),
            T.StructField("first", T.LongType()),
            T.StructField("ids", T.StringType()),
        ]
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            columns = [pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()),
                       pa.array([",".join(map(str, ids))])]
            ids.clear()
            return pa.RecordBatch.from_arrays(columns, names=pieces.fieldNames())

        for batch in batches:
            for k, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (k != key or len(ids) == IDS_PER_CHUNK):
                    yield piece()
                key = k
                ids.append(i)
        if ids:
            yield piece()

    hashed = T.StructType(
        [T.StructField("key", T.BinaryType()), T.StructField("ends_sha256", T.StringType())]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, ([], [])
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done[0].append(key)
                        done[1].append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())],
                names=hashed.fieldNames(),
            )
            done = ([], [])
        if key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([state.hexdigest()])],
                names=hashed.fieldNames(),
            )

    chunks = ordered.mapInArrow(join, pieces)
    # Written first: both hashing and its sort then deal with pieces, not ids.
    chunks = materialize(chunks).repartition("key").sortWithinPartitions("key", "first")
    return chunks.mapInArrow(digest, hashed)


def described(conversations: DataFrame) -> DataFrame:
    """The nodes with a digest of the conversations that end at each: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = trie(conversations)
    nothing = hashlib.sha256(b"").hexdigest()
    digests = joined_digest(found.ends)
    return found.nodes.join(digests, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


SQL = """
with bits as (
    select list_transform(range(256), lambda i: list_reduce(
        list_prepend(i, range(8)),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as remainders
), turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
        partition by conv_id
        order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as at
    from conversations where conv_id is not null
), ids as (
    select conv_id, conv_id - conv_id % 5 as base, count(*) as there,
        list_prepend(4294967295, list_transform(
            string_split(conv_id::varchar, ''), lambda s: ord(s)::bigint)) as signs
    from turns group by conv_id
), heads as (
    select conv_id, base, there, xor(list_reduce(
        signs, lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295) % 9 as h
    from ids, bits
), plans as (
    select p.conv_id, p.base, p.h, least(p.h, coalesce(b.there, 0)) as taken
    from heads p left join heads b on b.conv_id = p.base
), rebuilt as (
    select p.conv_id, t.at as depth, role, text
    from plans p join turns t on t.conv_id = p.base and t.at <= p.taken
    union all
    select p.conv_id, t.at - p.h + p.taken, role, text
    from plans p join turns t on t.conv_id = p.conv_id and t.at > p.h
), paths as (
    select p.conv_id, coalesce(list([role, text] order by depth) filter (depth is not null), []) as path
    from plans p left join rebuilt using (conv_id) group by p.conv_id
), steps as (
    select conv_id, depth, sha256(path[:depth]::json::varchar) as key,
        case when depth > 0 then sha256(path[:depth - 1]::json::varchar) end as parent,
        case when depth > 0 then octet_length(encode(path[depth][2])) else 0 end as n_bytes,
        depth = len(path) as ends
    from paths, unnest(range(0, len(path) + 1)) as u(depth)
), nodes as (
    select depth, key, parent, n_bytes, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), ''))
            as ends_sha256
    from steps group by all
), children as (
    select parent as key, count(*) as n_children from nodes where depth > 0 group by parent
), sums as (
    select s.key, count(*) filter (c.key is null) as n_leaves,
        sum((n.n_convs - 1) * n.n_bytes) as saved_tokens
    from nodes n join steps s on s.conv_id = n.conv_id and s.depth <= n.depth
        left join children c on c.key = n.key
    group by s.key
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs,
    coalesce(n_children, 0) as n_children, n_leaves, saved_tokens::bigint as saved_tokens,
    n.ends_sha256
from nodes n join sums using (key) left join children c on c.key = n.key
    left join nodes p on p.key = n.parent and n.depth > 0
"""
