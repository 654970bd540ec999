"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of u is linked with the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), 2 * rows)
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b").where(F.col("a") < F.col("b")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """u and its smaller neighbours are linked with the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), rows)
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where(F.col("a") < F.col("b")).distinct()


def components(edges: DataFrame, rows: int | None = None, most: int = 60) -> DataFrame:
    """(id, component): for every end of edges(a, b), the least id it is connected with.

    Each round writes its edges to the shared folder. Rounds end when the edges no longer change: every edge
    then leads from the least id of a component to another of its ids. Joins are on one small column pair, with
    both sides freshly exchanged, so that adaptive execution can split a hub's partition. Null ends and
    self-links are dropped; an empty table has no components. rows: a bound on the number of edges, if it is known.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct(), rows)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = mark(now)
    for _ in range(most):
        if not seen[0]:
            break
        now = stored(_small_star(_large_star(now, seen[0]), 2 * seen[0]), 2 * seen[0])
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
