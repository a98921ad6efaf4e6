"""Operator 2: exact top-k inner products by ball trees.

Vectors are dealt to shards of a bounded number of rows, and each shard is packed into one
row with a ball tree over its vectors. Queries are packed into blocks. A block visits a
shard's nodes in order of the largest upper bound of an inner product, q.c + |q| r, and
skips a node for every query whose k-th score so far is above that query's bound. The
first wave searches one shard per block; its k-th scores are shared with all other shards,
which then start with bounds that prune. Every block meets every shard, in an equi-join
on the shard; no pair of vectors is ever a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import materialize

LEAF = 64
SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024
NEVER = int(np.iinfo(np.int64).min)


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as a double; null for a vector that is null, empty
    or holds a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    floors = F.transform(wide, lambda x: F.floor(x * scale).cast("double"))
    return F.when(finite & (F.size(vector) > 0), floors)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two arrays of integral doubles. A product
    beyond 64 bits raises."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object) for m in (a, b)]
    return (whole[0] @ whole[1].T).astype(np.int64)


@dataclass
class BallTree:
    """Nodes over an order of the rows; children of -1 mark a leaf."""

    order: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    spans: np.ndarray
    children: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(vectors))
        centers, radii, spans, children = [], [], [], []

        def node(a: int, b: int) -> int:
            held = vectors[order[a:b]]
            center = held.mean(axis=0)
            centers.append(center)
            radii.append(np.sqrt(((held - center) ** 2).sum(axis=1).max()))
            spans.append((a, b))
            children.append((-1, -1))
            return len(centers) - 1

        todo = [node(0, len(vectors))]
        while todo:
            at = todo.pop()
            a, b = spans[at]
            if b - a <= leaf:
                continue
            held = vectors[order[a:b]]
            one = held[((held - centers[at]) ** 2).sum(axis=1).argmax()]
            other = held[((held - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(held @ (other - one), half)]
            children[at] = (node(a, a + half), node(a + half, b))
            todo.extend(children[at])
        arrays = (centers, radii, spans, children)
        return cls(order, *(np.array(x) for x in arrays))


def search(
    vectors: np.ndarray,
    ids: np.ndarray,
    rows: np.ndarray,
    tree: BallTree,
    queries: np.ndarray,
    query_rows: np.ndarray,
    kth: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best k in the shard (NEVER where there are fewer) that
    reach the query's score in `kth`, which rises as better ones are found."""
    kth = kth.copy()
    scores = np.full((len(queries), k), NEVER)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    lengths = np.sqrt((queries**2).sum(axis=1))

    def bounds(at: int, who: np.ndarray) -> np.ndarray:
        bound = queries[who] @ tree.centers[at] + lengths[who] * tree.radii[at]
        return bound + 1e-9 * np.abs(bound) + 1e-3  # no rounding may hide an equal score

    everyone = np.arange(len(queries))
    first = bounds(0, everyone)
    heap = [(-first.max(), 0, everyone, first)]
    while heap:
        _, at, who, bound = heapq.heappop(heap)
        who = who[bound >= kth[who]]
        if not len(who):
            continue
        if tree.children[at][0] >= 0:
            for child in tree.children[at].tolist():
                own = bounds(child, who)
                reach = own >= kth[who]
                if reach.any():
                    heapq.heappush(heap, (-own[reach].max(), child, who[reach], own[reach]))
            continue
        held = tree.order[slice(*tree.spans[at])]
        new = products(queries[who], vectors[held])
        new[query_rows[who][:, None] == rows[held][None, :]] = NEVER
        new[new < kth[who][:, None]] = NEVER
        better = (new > NEVER).any(axis=1)
        who, new = who[better], new[better]
        all_scores = np.hstack([scores[who], new])
        all_ids = np.hstack([found[who], np.broadcast_to(ids[held], new.shape)])
        best = np.lexsort((all_ids, ~all_scores), axis=-1)[:, :k]  # ~x falls as x rises
        scores[who] = np.take_along_axis(all_scores, best, axis=1)
        found[who] = np.take_along_axis(all_ids, best, axis=1)
        kth[who] = np.maximum(kth[who], scores[who, -1])
    return scores, found


def _packed(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key and number of components with the columns as arrays of bytes. A key
    has a bounded number of rows."""

    def pack(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(group["vector"].tolist(), dtype="<f8")
        packed = {key: [keys[0]], "width": [keys[1]], "vectors": [vectors.tobytes()]}
        for c in columns:
            packed[c] = [group[c].to_numpy(dtype="<i8").tobytes()]
        return pd.DataFrame(packed)

    schema = f"{key} bigint, width int, vectors binary" + "".join(f", {c} binary" for c in columns)
    return rows.groupBy(key, "width").applyInPandas(pack, schema)


def _searched(shards: DataFrame, blocks: DataFrame, pairs: int, k: int) -> DataFrame:
    """query, id, score: each query's best k of the shard that its block meets."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pair in frame.itertuples(index=False):
                vectors, queries = (
                    np.frombuffer(x, dtype="<f8").reshape(-1, pair.width)
                    for x in (pair.vectors, pair.query_vectors)
                )
                ids, rows, queried, kth = (
                    np.frombuffer(x, dtype="<i8")
                    for x in (pair.ids, pair.rows, pair.query_rows, pair.kth)
                )
                tree = BallTree.build(vectors)
                scores, found = search(vectors, ids, rows, tree, queries, queried, kth, k)
                at, _ = hit = np.nonzero(scores > NEVER)
                yield pd.DataFrame({"query": queried[at], "id": found[hit], "score": scores[hit]})

    joined = blocks.join(shards, ["shard", "width"]).repartition(pairs, "shard", "block")
    return joined.mapInPandas(task, "query bigint, id bigint, score bigint")


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 64,
) -> DataFrame:
    """query_id, rank (from 1), `<id>`, score: for every row that is a query, the k other rows
    with the highest inner product of quantized vectors, or all if there are fewer.

    Equal scores go to the smaller id. Vectors that are null, empty or hold a null or
    non-finite component take no part, nor do rows without an id; vectors meet only those
    of as many components. A repeated row is a row of its own, as query and as candidate.
    An empty table, or one without queries, gives no rows. Runs jobs when called.
    """
    spark = rows.sparkSession
    staged = materialize(
        rows.select(
            rows[id_column].cast("bigint").alias("ids"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
            quantized(rows[vector_column], scale).alias("vector"),
        )
        .filter(F.col("ids").isNotNull() & F.col("vector").isNotNull())
        .withColumn("width", F.size("vector"))
        .withColumn("rows", F.monotonically_increasing_id())
    )
    total, asked = staged.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    n_shards = max(1, -(-total // SHARD_ROWS))
    n_blocks = max(1, -(-asked // BLOCK_QUERIES))
    dealt = F.xxhash64("rows")
    shards = materialize(
        _packed(
            staged.withColumn("shard", F.pmod(dealt, F.lit(n_shards))), "shard", ["ids", "rows"]
        )
    )
    asking = staged.filter("asks").withColumn("block", F.pmod(dealt, F.lit(n_blocks)))
    home = F.pmod("block", F.lit(n_shards))

    def blocks(queries: DataFrame) -> DataFrame:
        packed = _packed(queries, "block", ["rows", "kth"])
        return packed.withColumnsRenamed({"rows": "query_rows", "vectors": "query_vectors"})

    unknown = asking.withColumn("kth", F.lit(NEVER))
    first = materialize(
        _searched(shards, blocks(unknown).withColumn("shard", home), n_blocks, k)
    )
    reached = (
        first.groupBy(F.col("query").alias("rows"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        .select("rows", F.when(F.col("n") >= k, F.col("least")).alias("reached"))
    )
    shared = asking.join(reached, "rows", "left").withColumn(
        "kth", F.coalesce("reached", F.lit(NEVER))
    )
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint")))
    rest = _searched(
        shards,
        blocks(shared).withColumn("shard", others).filter(F.col("shard") != home),
        n_blocks * n_shards,
        k,
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    names = staged.filter("asks").select(F.col("rows").alias("query"), F.col("ids").alias("query_id"))
    return (
        first.unionByName(rest)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .join(names, "query")
        .select("query_id", "rank", F.col("id").alias(id_column), "score")
    )


# Whole numbers below 2**53 are exact in the double-precision product.
SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
