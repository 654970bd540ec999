"""Variable-length paths: enumeration level by level, meeting in the middle, reachability.

All functions work on keys: a struct of label and id, or the id alone where it is unique. Edges are a frame of
f, t (keys of the ends in the direction of travel) and, if a query asks for the relationships, e (what is collected
of an edge); rows have a column rels only then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import stored

#: Up to so many levels are one lazy plan; longer searches write each level to the shared folder.
UNROLL = 3


def start(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth-0 rows of seeds(k)."""
    return seeds.select(F.col("k").alias("s"), F.col("k").alias("n"), F.lit(0).alias("depth"), F.array("k").alias("path"), *_no_rels(edges))


def _no_rels(edges: DataFrame) -> list[Column]:
    return [F.array().cast(f"array<{edges.schema['e'].dataType.simpleString()}>").alias("rels")] if "e" in edges.columns else []


def step(level: DataFrame, edges: DataFrame, circular: bool) -> DataFrame:
    """Rows one edge longer: to nodes not yet on the path, or back to the start, where a circle ends."""
    new = ~F.array_contains("path", F.col("t"))
    if circular:
        level = level.where((F.col("depth") == 0) | (F.col("n") != F.col("s")))
        new = new | (F.col("t") == F.col("s"))
    longer = level.join(edges, level["n"] == edges["f"]).where(new)
    return longer.select("s", F.col("t").alias("n"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("t")).alias("path"), *([F.array_append("rels", F.col("e")).alias("rels")] if "e" in edges.columns else []))


def _open(level: DataFrame, barrier: DataFrame | None) -> DataFrame:
    """Rows that go on: barrier(k) nodes are reached but not left. A path may start at one."""
    if barrier is None:
        return level
    return level.join(barrier.select(F.col("k").alias("stop")), (F.col("n") == F.col("stop")) & (F.col("depth") > 0), "left_anti")


def levels(seeds: DataFrame, edges: DataFrame, most: int, circular: bool = False, barrier: DataFrame | None = None) -> list[DataFrame]:
    """Paths of length 0, 1, ... most (fewer if a level is empty)."""
    out = [start(seeds, edges)]
    eager = most > UNROLL
    if eager:
        edges = stored(edges)
    for _ in range(most):
        level = step(_open(out[-1], barrier), edges, circular)
        if eager:
            level = stored(level)
            if level.isEmpty():
                break
        out.append(level)
    return out


def paths(seeds: DataFrame, edges: DataFrame, least: int, most: int, circular: bool = False, barrier: DataFrame | None = None) -> DataFrame:
    """(s, n, depth, path and maybe rels): node-simple paths of least to most edges from seeds(k).

    A circular search gives paths that end where they start; these close once.
    """
    found = levels(seeds, edges, most, circular, barrier)[least : most + 1]
    if not found:
        return start(seeds, edges).where(F.lit(False))
    rows = reduce(DataFrame.union, found)
    return rows.where("n = s") if circular else rows


def meeting(seeds: DataFrame, targets: DataFrame, edges: DataFrame, least: int, most: int, barrier: DataFrame | None = None) -> DataFrame:
    """paths() that end in targets(k), searched from both ends: half the length from each.

    A path of length L is the pair of its first ceil(L / 2) and last floor(L / 2) edges, so each is met once.
    Barriers stop the forward half as in paths(); in the backward half a barrier may only be the target.
    """
    more = [c for c in edges.columns if c == "e"]
    back_edges = edges.select(F.col("t").alias("f"), F.col("f").alias("t"), *more)
    ahead = levels(seeds, edges, (most + 1) // 2, barrier=barrier)
    behind = [start(targets, edges)]
    for _ in range(most // 2):
        last = behind[-1]
        nxt = step(last, back_edges, False)
        if barrier is not None:  # the node just added is left by the path, so it can't be a barrier unless it is the start
            nxt = nxt.join(barrier.select(F.col("k").alias("stop")), F.col("n") == F.col("stop"), "left_anti")
        if most > UNROLL:
            nxt = stored(nxt)
            if nxt.isEmpty():
                break
        behind.append(nxt)
    out = []
    for n in range(least, most + 1):
        i, j = (n + 1) // 2, n // 2
        if i >= len(ahead) or j >= len(behind):
            continue
        a = ahead[i] if j == 0 else _open(ahead[i], barrier)
        b = behind[j].select(F.col("s").alias("end"), F.col("n").alias("meet"), F.col("path").alias("path2"), *(F.col("rels").alias("rels2") for _ in more))
        rest = F.slice(F.reverse("path2"), 2, F.greatest(F.size("path2") - 1, F.lit(1)))
        rest = F.when(F.size("path2") > 1, rest).otherwise(F.slice("path2", 1, 0))
        met = a.join(b, F.col("n") == F.col("meet")).where(~F.arrays_overlap("path", rest))
        out.append(met.select("s", F.col("end").alias("n"), F.lit(n).alias("depth"), F.concat("path", rest).alias("path"), *(F.concat("rels", F.reverse("rels2")).alias("rels") for _ in more)))
    return reduce(DataFrame.union, out) if out else start(seeds, edges).where(F.lit(False))


def distances(targets: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(n, left): nodes from which one of targets(k) is at most so many edges away, and the fewest it takes.

    Barriers are not looked at, so some of these nodes may not get there.
    """
    level = stored(targets.select(F.col("k").alias("n"), F.lit(0).alias("left")).distinct())
    seen = level
    for d in range(1, most + 1):
        back = level.join(edges, level["n"] == edges["t"]).select(F.col("f").alias("n")).distinct()
        level = stored(back.join(seen.select("n"), "n", "left_anti").select("n", F.lit(d).alias("left")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def reachable(seeds: DataFrame, edges: DataFrame, least: int, most: int, barrier: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(s, n, depth, path and maybe rels): each node once for each start, at its least depth; path is null, rels the last edge.

    Breadth-first: a level is the frontier joined with the edges, less what the start has visited. Each level and
    the visited set are written to the shared folder, so lineage stays short and a lost executor costs one level.
    With targets(k), a search back from these comes first, and nodes from which none is near enough are left out.
    """
    edges = stored(edges)
    rels = "e" in edges.columns
    near_target = distances(targets, edges, most) if targets is not None else None

    def near_enough(rows: DataFrame, d: int) -> DataFrame:
        return rows if near_target is None else rows.join(near_target, "n").where(F.col("left") + d <= most).drop("left")

    level = near_enough(seeds.select(F.col("k").alias("s"), F.col("k").alias("n"), F.lit(0).alias("depth"), *_no_rels(edges)), 0)
    visited, found = level.select("s", "n"), [level] if least == 0 else []
    for d in range(1, most + 1):
        near = _open(level, barrier).select("s", "n")
        reached = near.join(edges, near["n"] == edges["f"]).select("s", F.col("t").alias("n"), *(["e"] if rels else []))
        reached = near_enough(reached.groupBy("s", "n").agg(F.min("e").alias("e")) if rels else reached.distinct(), d)
        level = stored(reached.join(visited, ["s", "n"], "left_anti").select("s", "n", F.lit(d).alias("depth"), *([F.array("e").alias("rels")] if rels else [])))
        if level.isEmpty():
            break
        if d >= least:
            found.append(level)
        visited = visited.unionByName(level.select("s", "n"))
    if not found:
        found = [level.where(F.lit(False))]
    rows = reduce(DataFrame.unionByName, found)
    key: Column = F.lit(None).cast(f"array<{rows.schema['n'].dataType.simpleString()}>")
    return rows.select("s", "n", "depth", key.alias("path"), *(["rels"] if rels else []))
