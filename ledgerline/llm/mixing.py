"""Operator 8: mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern, and a
flow network routes words from the patterns to the sources' quotas: a pattern can be used
once at no cost and again at a cost that grows with every repetition, so the cheapest flow
repeats as little as the quotas allow. The network has a node per pattern and per source,
never per document. A pattern's flow is then turned into documents: all of them as often as
the flow covers the pattern, and for the rest documents in seeded order up to the amount,
closed by the few documents that fit the remaining gap best.

The seeded order is cut without sorting a pattern in one task: sums over the leading bits of
the hash find the bits where the amount is reached, then the next bits inside them.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD
from ledgerline.session import materialize

MAX_REPEATS = 3
SMALL_PLAN = 10_000  # patterns up to which a plan, one short row each, is sent to all tasks
CLOSING = 8  # documents that may be taken out of order to close a pattern's gap
# Bits of the hash of a row, then of the hash of its number, that are settled by each round.
ROUNDS = (("h", 52), ("h", 40), ("h", 28), ("h", 0), ("x", 52), ("x", 40), ("x", 0))


def default_weights(sources: Sequence[str | None], cycle: Sequence[int] = (1, 2, 3)) -> dict:
    """Weights 1, 2, 3, 1, ... of the sources by code point, the missing one last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def targets(sizes: Mapping, weights: Mapping, total: int, most: int = MAX_REPEATS) -> dict:
    """Shares of the total by weight; a source stops at `most` times its size and the excess
    is shared again by weight until no source is above."""
    found: dict = {}
    free, rest = dict(weights), Fraction(total)
    while free:
        level = rest / sum(free.values()) if sum(free.values()) else Fraction(0)
        full = [s for s, w in free.items() if level * w > most * sizes[s]]
        if not full:
            return found | {s: level * w for s, w in free.items()}
        for s in full:
            found[s] = Fraction(most * sizes[s])
            rest -= found[s]
            del free[s]
    return found


def route(
    patterns: Mapping[tuple, int], quotas: Mapping, most: int = MAX_REPEATS
) -> dict[tuple, int]:
    """Words taken from each pattern (a tuple of its sources): a cheapest largest flow into
    the quotas, where the k-th use of a pattern's size costs k - 1 a word."""
    names = [("pattern", p) for p in patterns] + [("source", s) for s in quotas]
    node = {n: i + 2 for i, n in enumerate(names)}
    start, end = 0, 1
    heads: list[list[int]] = [[] for _ in range(len(names) + 2)]
    to, room, price = [], [], []

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            heads[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(p)

    for pattern, size in patterns.items():
        for use in range(most):
            arc(start, node["pattern", pattern], size, use)
        for source in pattern:
            arc(node["pattern", pattern], node["source", source], most * size, 0)
    for source, quota in quotas.items():
        arc(node["source", source], end, quota, 0)

    potential = [0] * len(heads)
    while True:  # augment along cheapest paths, with reduced costs
        distance: list = [None] * len(heads)
        via = [-1] * len(heads)
        distance[start] = 0
        queue = [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for e in heads[a]:
                reduced = d + price[e] + potential[a] - potential[to[e]]
                if room[e] and (distance[to[e]] is None or reduced < distance[to[e]]):
                    distance[to[e]], via[to[e]] = reduced, e
                    heapq.heappush(queue, (reduced, to[e]))
        if distance[end] is None:
            break
        furthest = max(d for d in distance if d is not None)
        potential = [
            p + (furthest if d is None else d) for p, d in zip(potential, distance, strict=True)
        ]
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    taken = dict.fromkeys(patterns, 0)
    for e in heads[start]:
        taken[names[to[e] - 2][1]] += room[e ^ 1]
    return taken


@dataclass
class Cut:
    """What is chosen of a pattern: `base` uses of every document, one more of those before
    the boundary, and one more of the closing rows."""

    base: int
    amount: int  # still to be covered by documents in seeded order
    prefix: tuple = ()
    settled: bool = False
    closing: list = field(default_factory=list)


@dataclass
class Mix:
    """The rows with their repeats, and each source's size and target."""

    rows: DataFrame
    sizes: dict
    targets: dict

    def sources(self, name: str = "source") -> DataFrame:
        data = [(s, size, self.targets[s]) for s, size in self.sizes.items()]
        return _plan(
            self.rows.sparkSession, data, f"{name} string, source_size bigint, target double"
        )


def _plan(spark: SparkSession, data: list, columns: str) -> DataFrame:
    """Rows that the driver holds, to be joined with any table: sent to all tasks if few."""
    frame = spark.createDataFrame(data, columns)
    return F.broadcast(frame) if len(data) <= SMALL_PLAN else frame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(
    docs: DataFrame,
    membership: Column,
    weights: Mapping | None = None,
    most: int = MAX_REPEATS,
    seed: int = 7,
    text_column: str = "text",
    names: Mapping[str, str] | None = None,
) -> Mix:
    """Choose how often every row is used so that each source gets its share of all words.

    `membership` is an array of the sources of a row, nulls allowed as a source of their
    own. Rows whose array is empty or missing are not used. Weights default to 1, 2, 3 by
    code point. Returned rows have all columns of docs and `size` and `repeats` (0 to
    `most`), or as `names` calls them; a clash with a column of docs raises. A null text has
    no words; a document without words adds nothing and is used as often as its pattern's
    fullest uses. Equal rows are separate documents. An empty table gives no rows and no
    targets. The driver holds one line per membership pattern. Runs jobs when called.
    """
    called = {"size": "size", "repeats": "repeats", **(names or {})}
    clash = {c.lower() for c in docs.columns} & {c.lower() for c in called.values()}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    columns = [docs[c] for c in docs.columns]
    hashable = [c for c in docs.columns if "map" not in dict(docs.dtypes)[c]]
    keyed = docs.select(
        *[c.alias(f"c{i}") for i, c in enumerate(columns)],
        F.to_json(F.array_sort(F.array_distinct(membership))).alias("pattern"),
        F.array_sort(F.array_distinct(membership)).alias("members"),
        word_count(docs[text_column]).alias("size"),
        F.xxhash64(F.lit(seed), *[docs[c] for c in hashable]).alias("h"),
        F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("x"),
    )
    slim = materialize(keyed.select("pattern", "members", "size", "h", "x"))
    found = (
        slim.filter(F.size("members") > 0)
        .groupBy("pattern")
        .agg(F.first("members").alias("members"), F.sum("size").alias("size"))
        .collect()
    )
    patterns = {tuple(r["members"]): r["size"] for r in found}
    name_of = {tuple(r["members"]): r["pattern"] for r in found}
    sizes: dict = {}
    for pattern, size in patterns.items():
        for source in pattern:
            sizes[source] = sizes.get(source, 0) + size
    chosen = dict(weights) if weights is not None else default_weights(list(sizes))
    wanted = targets(
        sizes, {s: chosen.get(s, 0) for s in sizes}, sum(patterns.values()), most
    )
    taken = route(patterns, {s: round(t) for s, t in wanted.items()}, most)
    cuts = {}
    for pattern, size in patterns.items():
        base = min(taken[pattern] // size, most) if size else 0
        cuts[name_of[pattern]] = Cut(base, taken[pattern] - base * size)
    _cut(slim, cuts)
    for _ in range(CLOSING):
        if not _close(slim, cuts):
            break

    repeats = _repeats(keyed, cuts)
    rows = repeats.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.col("size").alias(called["size"]),
        F.col("repeats").alias(called["repeats"]),
    )
    return Mix(rows, sizes, {s: float(t) for s, t in wanted.items()})


def _cut(slim: DataFrame, cuts: dict[str, Cut]) -> None:
    """Find where the rows in order of (h, x) reach each pattern's amount."""
    spark = slim.sparkSession
    for cut in cuts.values():
        cut.settled = cut.amount == 0
    for depth, (column, shift) in enumerate(ROUNDS):
        level = F.shiftright(column, shift)
        open_ = {p: c for p, c in cuts.items() if not c.settled}
        if not open_:
            return
        bounds = _plan(
            spark,
            [(p, c.amount, *c.prefix) for p, c in open_.items()],
            ", ".join(["pattern string", "amount bigint"])
            + "".join(f", p{i} bigint" for i in range(depth)),
        )
        inside = slim.join(bounds, "pattern")
        for i, (name, bits) in enumerate(ROUNDS[:depth]):
            inside = inside.filter(F.shiftright(name, bits) == F.col(f"p{i}"))
        by_level = inside.groupBy("pattern", "amount", level.alias("level")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")
        )
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("level"))
        crossing = (
            by_level.withColumn("upto", upto)
            .filter((F.col("upto") > F.col("amount")) & (F.col("upto") - F.col("words") <= F.col("amount")))
            .collect()
        )  # one row per pattern
        for row in crossing:
            cut = cuts[row["pattern"]]
            cut.amount -= row["upto"] - row["words"]
            cut.prefix = (*cut.prefix, row["level"])
            cut.settled = row["rows"] == 1 or cut.amount == 0
        for cut in open_.values():
            if len(cut.prefix) <= depth:
                raise AssertionError("an amount beyond the pattern's words")


def _close(slim: DataFrame, cuts: dict[str, Cut]) -> bool:
    """Choose for each pattern the row, not chosen yet, whose size is nearest to the gap, if
    it narrows it; whether there was one."""
    if all(c.amount <= 0 for c in cuts.values()):
        return False
    off = F.abs(F.col("size") - F.col("gap"))
    nearest = (
        _chosen(slim, cuts)
        .filter(~F.col("more") & (F.col("gap") > 0) & (F.col("size") > 0) & (off < F.col("gap")))
        .groupBy("pattern")
        .agg(F.min(F.struct(off.alias("off"), "h", "x", "size")).alias("at"))
        .collect()
    )
    for row in nearest:
        cuts[row["pattern"]].closing.append((row["at"]["h"], row["at"]["x"]))
        cuts[row["pattern"]].amount -= row["at"]["size"]
    return bool(nearest)


def _chosen(rows: DataFrame, cuts: dict[str, Cut]) -> DataFrame:
    """The rows with their pattern's base and gap, and whether they have one use more.

    A boundary is the levels of its rounds; a row is before it if its own levels are less in
    order. Patterns with no boundary have no row before it.
    """
    depth = len(ROUNDS)
    data = []
    for pattern, cut in cuts.items():
        prefix = [*cut.prefix, *[None] * (depth - len(cut.prefix))]
        data.append((pattern, cut.base, cut.amount, cut.closing, *prefix))
    plan = _plan(
        rows.sparkSession,
        data,
        "pattern string, base int, gap bigint, closing array<struct<h: bigint, x: bigint>>"
        + "".join(f", p{i} bigint" for i in range(depth)),
    )
    before = F.lit(False)
    for i, (name, bits) in reversed(list(enumerate(ROUNDS))):
        own, bound = F.shiftright(name, bits), F.col(f"p{i}")
        before = F.when(bound.isNull() | (own > bound), F.lit(False)).otherwise(
            F.when(own < bound, F.lit(True)).otherwise(before)
        )
    closing = F.coalesce(F.array_contains("closing", F.struct("h", "x")), F.lit(False))
    return (
        rows.join(plan, "pattern", "left")
        .withColumn("more", before | closing)
        .drop("closing", *[f"p{i}" for i in range(depth)])
    )


def _repeats(rows: DataFrame, cuts: dict[str, Cut]) -> DataFrame:
    uses = F.col("base") + F.col("more").cast("int")
    return _chosen(rows, cuts).withColumn("repeats", F.coalesce(uses, F.lit(0)))
