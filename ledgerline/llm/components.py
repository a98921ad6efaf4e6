"""Connected components of a table of links, by alternating star operations.

Each round rewires every link towards smaller members with grouped minima and equi-joins,
so a member with any number of links is combined on the map side or split by the skewed
join, never gathered. Rounds are written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """`member`, `root` for every value in a link: the smallest value it is connected to.

    Links with a null or with equal ends are ignored; no links give no rows. Runs jobs when
    called, about two for each doubling of the longest path.
    """
    a, b = F.col(left), F.col(right)
    edges = materialize(
        links.filter(a != b)
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    state = _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            return _rooted(edges)


def _state(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashed).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every member's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select(F.col("low").alias("at"), F.col("high").alias("to")).unionByName(
        edges.select(F.col("high").alias("at"), F.col("low").alias("to"))
    )
    least = both.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("least"))
    larger = edges.select(F.col("low").alias("at"), F.col("high").alias("to"))
    return (
        larger.join(least, "at").select(F.col("to").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every member and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    joined = edges.join(least, "high")
    moved = joined.filter(F.col("low") != F.col("least")).select(
        F.col("low").alias("high"), F.col("least").alias("low")
    )
    return least.select("high", F.col("least").alias("low")).unionByName(moved).distinct()


def _rooted(edges: DataFrame) -> DataFrame:
    members = edges.select(F.col("high").alias("member"), F.col("low").alias("root"))
    roots = edges.select(F.col("low").alias("member"), F.col("low").alias("root")).distinct()
    return members.unionByName(roots)
