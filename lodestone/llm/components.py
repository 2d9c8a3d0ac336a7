"""Connected components over link tables, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, keep


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `links` (columns a, b).

    Large-star and small-star steps alternate until nothing moves; every id then points at
    the smallest of its component. The links never leave the executors; each round is
    written to the shared folder. Self links give components of one. Empty in, empty out.
    """
    a, b = F.col("a"), F.col("b")
    edges = keep(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    for _ in range(rounds):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.select(b.alias("n"), a.alias("v")).join(low.withColumnRenamed("a", "n"), "n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b"))).distinct()
        moved = keep(small)
        discard(edges)
        edges = moved
        # done when no node points at two, or at one that points on
        ends = edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            break
    else:
        raise RuntimeError(f"components still moving after {rounds} rounds")
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
