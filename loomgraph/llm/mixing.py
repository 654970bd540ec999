"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Slot k of the schedule looks at the point frac(k * phi) of the golden-ratio sequence and belongs to the
source whose stretch of the cumulative weights holds that point, so every prefix of the schedule is close
to the weights. Slots are ranked per source; the r-th slot of a source takes the r-th block of
``block_words`` words of that source's documents in shuffled (hash) order, round and round. Only DataFrame
operations. Sums that need an order are two-level prefix sums, so a source with a third of all rows is dealt
over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD_PATTERN, stored

WEIGHTS = (5.0, 2.0, 1.0)
GOLDEN = 0.6180339887498949
FAN = 1024  # children of a node of the prefix-sum tree
CELLS = 4096  # of the unit interval, for finding the source of a point
#: Most sources: one row each goes to the driver and is broadcast; the number is checked.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words for each source: share of the total by weight, capped at cap times the source's size and reshared."""
    want, capped = float(sum(sizes)) * share, [False] * len(sizes)
    while True:
        left = want - sum(cap * s for s, c in zip(sizes, capped, strict=True) if c)
        total = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        out = [cap * s if c else (left * w / total if total else 0.0) for s, w, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > cap * s for t, s, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def _before(by: Sequence, order: Sequence) -> Column:
    """Sum of n over the earlier rows of a window."""
    return F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def order_key(doc_id: Column) -> Column:
    """Place of a document in its source's shuffled order: 63 bits of a hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(17)), 1)


def placed(rows: DataFrame, n: int | None = None) -> DataFrame:
    """rows(sx, doc_id, size, ...), n of them if that is known, with start: the words before the row in its source's shuffled order.

    Ties in the order are rows alike in id and size, so any order of them gives the same result. The sums run
    over a tree: FAN groups in a source, FAN groups in each of these, then rows; the widest window over groups
    has FAN rows, the widest over documents 1 / FAN**2 of a source.
    """
    rows = rows.withColumn("h", order_key(F.col("doc_id"))).withColumn("b1", F.shiftright("h", 53)).withColumn("b2", F.shiftright("h", 43).bitwiseAND(F.lit(FAN - 1))).withColumn("n", F.col("size"))
    leaf = stored(rows.groupBy("sx", "b1", "b2").agg(F.sum("n").alias("n")), n)
    top = leaf.groupBy("sx", "b1").agg(F.sum("n").alias("n")).select("sx", "b1", _before(["sx"], ["b1"]).alias("s1"))
    groups = leaf.select("sx", "b1", "b2", _before(["sx", "b1"], ["b2"]).alias("s2")).join(top, ["sx", "b1"])
    rows = rows.withColumn("s3", _before(["sx", "b1", "b2"], ["h", "doc_id"]))
    return rows.join(groups, ["sx", "b1", "b2"]).withColumn("start", F.col("s1") + F.col("s2") + F.col("s3")).drop("b1", "b2", "n", "s1", "s2", "s3")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """(sx, rank): the slots of the golden-ratio schedule, each with its source and its rank within the source.

    plan has a row (sx, lo, hi) a source, its stretch of the unit interval. The stretch is found by an equi-join
    on CELLS cells of the interval. Ranks are two-level counts, so no task ranks all slots of a source.
    """
    point = (F.col("id") + 0.5) * F.lit(GOLDEN)
    drawn = plan.sparkSession.range(0, slots).select(F.col("id").alias("k"), (point - F.floor(point)).alias("u"))
    cells = plan.select("sx", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * CELLS)).join(F.broadcast(cells), "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    drawn = stored(drawn.select("sx", "k", F.shiftright("k", 12).alias("kb"), F.shiftright("k", 22).alias("kh")), slots)
    count = drawn.groupBy("sx", "kb", "kh").agg(F.count(F.lit(1)).alias("n"))
    high = count.groupBy("sx", "kh").agg(F.sum("n").alias("n")).select("sx", "kh", _before(["sx"], ["kh"]).alias("r1"))
    low = count.select("sx", "kb", "kh", _before(["sx", "kh"], ["kb"]).alias("r0")).join(high, ["sx", "kh"])
    own = F.row_number().over(W.partitionBy("sx", "kb").orderBy("k")) - 1
    return drawn.select("sx", "kb", own.alias("r2")).join(low, ["sx", "kb"]).select("sx", (F.col("r0") + F.col("r1") + F.col("r2")).alias("rank"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the document in the mix, repeats counted), h.

    Sources are taken by code point, null last, and weigh ``weights`` in turn. Null and empty texts have size 0
    and are taken 0 times; a null id is an id like others; repeated rows are separate documents; an empty table
    gives an empty result. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    n = rows.count()
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()  # a row a source
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # by code point
    sizes = [int(r["size"] or 0) for r in found]
    goals = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share, cap)
    total, at, plan = sum(goals) or 1.0, 0.0, []
    for i, (r, size, target) in enumerate(zip(found, sizes, goals, strict=True)):
        plan.append((i, r["source"], size, float(target), int(min(round(target), int(cap * size))), at / total, (at + target) / total))
        at += target
    plan_df = F.broadcast(spark.createDataFrame(plan, "sx int, source string, source_size long, target double, goal long, lo double, hi double").coalesce(1))
    ranked = schedule(plan_df, int(total // block_words) + 1 if found else 0)

    # The schedule may be some slots short of a goal; closing slots make up. Slots past the goal have no words left.
    have = ranked.groupBy("sx").agg(F.count(F.lit(1)).alias("have"))
    need = F.ceil(F.col("goal") / block_words)
    closing = plan_df.join(have, "sx", "left").where(need > F.coalesce("have", F.lit(0))).select("sx", F.explode(F.sequence(F.coalesce("have", F.lit(0)), need - 1)).alias("rank"))
    # Slot r takes words [r * block, (r + 1) * block) of the endless round of its source's documents, up to the
    # goal; it is cut where a round ends, then at the borders of blocks.
    size, lo, hi = F.col("source_size"), F.col("rank") * block_words, F.least((F.col("rank") + 1) * block_words, F.col("goal"))
    cuts = ranked.unionByName(closing).join(plan_df.select("sx", "source_size", "goal"), "sx").where(lo < F.col("goal")).select("sx", "source_size", lo.alias("lo"), hi.alias("hi"))
    cuts = cuts.select("*", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))).alias("lap"))
    cuts = cuts.select("sx", (F.greatest("lo", F.col("lap") * size) - F.col("lap") * size).alias("lo"), (F.least("hi", (F.col("lap") + 1) * size) - F.col("lap") * size).alias("hi"))
    blocks_of = lambda first, last: F.explode(F.sequence(F.floor(first / block_words), F.floor((last - 1) / block_words))).alias("block")
    cuts = cuts.select("sx", "lo", "hi", blocks_of(F.col("lo"), F.col("hi")))

    keyed = rows.join(plan_df.select("sx", F.col("source").alias("s"), "source_size", "target"), rows["source"].eqNullSafe(F.col("s"))).drop("s")
    laid = stored(placed(keyed, n).withColumn("row", F.monotonically_increasing_id()), n)
    pieces = laid.where(F.col("size") > 0).select("row", "sx", F.col("start").alias("d0"), (F.col("start") + F.col("size")).alias("d1"), blocks_of(F.col("start"), F.col("start") + F.col("size")))
    shared = F.least("d1", "hi", (F.col("block") + 1) * block_words) - F.greatest("d0", "lo", F.col("block") * block_words)
    got = pieces.join(cuts, ["sx", "block"]).where(shared > 0).groupBy("row").agg(F.sum(shared).alias("taken"))
    return laid.join(got, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "h")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, with the columns of docs: each as often as a whole copy of it (rounded) is taken.

    In a source the mix takes whole rounds and then a stretch of the shuffled order, so two counts and one order
    key a source (a checked number of rows) say how often a document is taken: texts are not shuffled. Documents
    without words are kept once.
    """
    taken = mix(docs, **how).where(F.col("size") > 0).select("source", "h", F.round(F.col("taken") / F.col("size")).alias("copies"))
    taken = stored(taken, docs.count())
    least = taken.groupBy("source").agg(F.min("copies").alias("least"))
    upto = taken.join(F.broadcast(least).withColumnRenamed("source", "s"), taken["source"].eqNullSafe(F.col("s"))).groupBy(taken["source"].alias("mix_source")).agg(F.min("least").alias("mix_least"), F.max(F.when(F.col("copies") > F.col("least"), F.col("h"))).alias("mix_upto"))
    # names that docs has not
    free = "mix"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    upto = upto.toDF(f"{free}s", f"{free}l", f"{free}u")
    more = (order_key(docs["doc_id"]) <= F.coalesce(F.col(f"{free}u"), F.lit(-1))).cast("int")
    copies = F.when(word_count(docs["text"]) == 0, 1).otherwise(F.col(f"{free}l").cast("int") + more)
    dealt = docs.join(F.broadcast(upto), docs["source"].cast("string").eqNullSafe(F.col(f"{free}s")), "left")
    return dealt.where(copies > 0).select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies)).alias(f"{free}c")).drop(f"{free}c")
