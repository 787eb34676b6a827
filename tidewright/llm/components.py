"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Columns node, component: the smallest id that can be reached, for each id that has an edge.

    Null ends and loops are ignored. Links are never gathered on the driver: each round is two
    keyed minimums and two joins over the edge table, written to the shared folder, and star
    centres with very many edges are left to the adaptive skew join. The number of rounds grows
    with the logarithm of the longest path.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = settle(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = settle(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = settle(low.select("a", F.col("m").alias("b")).union(moved).distinct())
        seen = _mark(after)
        discard(large)
        discard(now)
        now, same, mark = after, seen == mark, seen
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
