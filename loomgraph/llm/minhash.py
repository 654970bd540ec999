"""MinHash near-duplicates: universal hash minima, banding, verification on full shingle sets, star components.

1. One pass over the texts gives each document its set size, a 128-bit key of its whole set and its bands.
2. Documents with equal sets form a class; only its least id goes on. Bands that two or more classes share make
   candidates: each member with the least id of the band, which is linear in the members.
3. Candidates that the sizes allow are compared on their full sets; links give components.
4. Documents that met one centre but are not in its component (outliers) are compared with all that met it, in
   blocks on an inverted index of full sets, so nothing rests on the choice of a centre: two documents that share
   a band share its centre, whatever its size. No pairs are emitted but links.

With ``bands`` bands of ``rows`` minima a pair of similarity 0.8 is missed with probability
(1 - 0.8**rows)**bands: 5e-8 for 32 bands of 4.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept, ready_workers, stored
from loomgraph.llm.components import components
from loomgraph.llm.words import mix, shingles, word_hashes

_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"


def _minima(sets: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each universal hash (multiply and add modulo 2**32, odd multiplier) its minimum over the set."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, (mul * x[None, i : i + 1024] + add).min(axis=1), out=best)
    return best


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    kept()
    rng = np.random.default_rng(seed)
    mul = (rng.integers(0, 1 << 32, bands * rows, np.uint32) | 1)[:, None].astype(np.uint32)
    add = rng.integers(0, 1 << 32, bands * rows, np.uint32)[:, None]
    salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for batch in batches:
        n, k1, k2, out = [], [], [], []
        for _, words in word_hashes(batch.column(1).to_pylist()):
            s = shingles(words, k)
            n.append(len(s))
            k1.append(np.bitwise_xor.reduce(s) if len(s) else 0)
            k2.append(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) if len(s) else 0)
            m = _minima(s, mul, add).reshape(bands, rows).astype(np.uint64) if len(s) else np.zeros((bands, rows), np.uint64)
            h = salt.copy()
            for j in range(rows):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + m[:, j])
            out.append(h.view(np.int64))
        arrays = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (k1, k2))]
        flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
        arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(n) + 1, bands, dtype=np.int32)), flat))
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "k1", "k2", "bands"])


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, ta, b, tb), mostly sorted by a, to the links (a, b)."""
    last, own = None, None
    for batch in batches:
        a, ta, b, tb = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for i, words in word_hashes(tb):
            if a[i] != last or last is None:
                last, own = a[i], shingles(next(w for _, w in word_hashes([ta[i]])), k)
            other = shingles(words, k)
            same = len(np.intersect1d(own, other, assume_unique=True))
            if same and 100 * same >= percent * (len(own) + len(other) - same):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def _outliers(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (hub, i, j), with side, doc_id, component, text, to links between components.

    Side 0 holds a part of a centre's outliers and side 1 another part of its documents; i = j has one side. A
    block has two parts at most, and only the sets of its documents are held.
    """
    def linked(rows: list[tuple[int, int, int, np.ndarray]], alone: bool) -> Iterator[tuple[int, int]]:
        asks = [r for r in rows if r[0] == 0]
        told = asks if alone else [r for r in rows if r[0] == 1]
        if not asks or not told:
            return
        size = np.array([len(r[3]) for r in told])
        flat, owner = np.concatenate([r[3] for r in told]), np.repeat(np.arange(len(told)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        for _, doc, comp, own in asks:
            same = np.zeros(len(told), np.int64)
            first, last = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            n = last - first
            cuts = np.flatnonzero(np.diff(np.cumsum(n) >> 20, prepend=0))  # about a million postings at once
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
                at = np.repeat(first[a:b] - np.concatenate(([0], np.cumsum(n[a:b])[:-1])), n[a:b]) + np.arange(n[a:b].sum()) if b > a else np.zeros(0, np.int64)
                same += np.bincount(owner[at], minlength=len(told))
            for t in np.flatnonzero((same > 0) & (100 * same >= percent * (len(own) + size - same))).tolist():
                if told[t][1] != doc and (p := find(comp)) != (q := find(told[t][2])):
                    root[p] = q
                    yield doc, told[t][1]

    def done(block: tuple | None, rows: list) -> pa.RecordBatch:
        found = [(min(x), max(x)) for x in linked(rows, block[1] == block[2])] if block else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    block, rows = None, []
    for batch in batches:
        hub, i, j, side, doc, comp, text = (batch.column(c).to_pylist() for c in range(7))
        for r, words in word_hashes(text):
            if (hub[r], i[r], j[r]) != block:
                yield done(block, rows)
                block, rows = (hub[r], i[r], j[r]), []
            rows.append((side[r], doc[r], comp[r], shingles(words, k)))
    yield done(block, rows)


def signatures(docs: DataFrame, k: int = 5, bands: int = 32, rows: int = 4, seed: int = 7) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (key of the whole set), bands (hashes of rows minima each)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_sign, k=k, bands=bands, rows=rows, seed=seed), _SIGNED)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough; texts(id, text)."""
    left = pairs.hint("merge").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    both = left.hint("merge").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").select("a", "ta", "b", "tb")
    return both.mapInArrow(partial(_compare, k=k, percent=percent), "a long, b long")


def _across(met: DataFrame, pairs: int, groups: DataFrame, texts: DataFrame, k: int, percent: int, part: int) -> DataFrame | None:
    """Links between documents of different components that met one centre; met(a: the centre, b) of so many pairs, texts(id, text)."""
    member = met.select(F.col("a").alias("hub"), F.col("b").alias("doc")).unionByName(met.select(F.col("a").alias("hub"), F.col("a").alias("doc")).distinct())
    own = groups.select(F.col("id").alias("doc"), "component")
    member = member.join(own, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    member = member.join(groups.select(F.col("id").alias("hub"), F.col("component").alias("core")), "hub", "left")
    member = stored(member.withColumn("out", F.col("component") != F.coalesce("core", "hub")).drop("core"), 2 * pairs)
    outs, cores = F.sum(F.col("out").cast("int")), F.sum((~F.col("out")).cast("int"))
    sizes = member.groupBy("hub").agg(outs.alias("n_out"), cores.alias("n_core")).where("n_out > 0")
    parts = lambda c: F.ceil(F.col(c) / part).cast("int")
    sizes = stored(sizes.withColumn("p_out", parts("n_out")).withColumn("p_core", parts("n_core")), pairs)
    copies = sizes.agg(F.sum(F.col("n_out") * (F.col("p_out") + F.col("p_core")) + F.col("n_core") * F.col("p_out"))).first()[0]
    if not copies:
        return None
    rows = member.join(sizes.select("hub", "p_out", "p_core"), "hub")
    # parts 0 to p_out - 1 hold outliers, those after them the rest
    own_part = F.when(F.col("out"), F.pmod(F.xxhash64("doc"), F.col("p_out"))).otherwise(F.col("p_out") + F.pmod(F.xxhash64("doc"), F.greatest("p_core", F.lit(1)))).cast("int")
    rows = rows.withColumn("p", own_part)
    asks = F.transform(F.sequence(F.col("p"), F.col("p_out") + F.col("p_core") - 1), lambda q: F.struct(F.col("p").alias("i"), q.alias("j"), F.lit(0).alias("side")))
    upto = F.least(F.col("p"), F.col("p_out")) - 1
    told = F.when(upto >= 0, F.transform(F.sequence(F.lit(0), upto), lambda q: F.struct(q.alias("i"), F.col("p").alias("j"), F.lit(1).alias("side"))))
    blocks = F.when(F.col("out"), F.concat(asks, F.coalesce(told, F.array().cast("array<struct<i:int,j:int,side:int>>")))).otherwise(told)
    rows = stored(rows.select("hub", "doc", "component", F.explode(blocks).alias("x")).select("hub", "x.i", "x.j", "x.side", "doc", "component"), copies)
    full = rows.hint("merge").join(texts.withColumnRenamed("id", "doc"), "doc").select("hub", "i", "j", "side", "doc", "component", "text")
    return stored(full.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(partial(_outliers, k=k, percent=percent), "a long, b long").distinct(), copies)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, seed: int = 7, part: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable, itself included), kept.

    Null and empty texts, and texts without words, have no shingles and link with nothing. Rows with a null id
    are kept and have a null component. Rows that share an id count as one document for links (its least set key
    is compared) and are all returned. Other columns of docs are not read.
    """
    ready_workers(docs.sparkSession, 64)
    signed = stored(signatures(docs, k, bands, rows, seed))
    n = signed.count()
    filled = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(filled.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), n)
    sets = ["k1", "k2", "n_shingles"]
    copies = classes.where(F.col("copies") > 1).select(*sets, "rep")
    same = filled.select(*sets, "doc_id").join(copies, sets).where(F.col("doc_id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = signed.join(same.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti").where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    banded = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.min_by("n", "doc_id").alias("hub_n"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "hub", "hub_n")
    met = banded.join(stored(hubs, bands * n), "band")
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  a larger set can't be that alike
    met = stored(met.where(F.col("doc_id") > F.col("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), fits(F.col("n"), F.col("hub_n")).alias("fits")).distinct(), bands * n)
    pairs = met.count()
    first = met.where("fits").select("a", "b")
    met = met.select("a", "b")
    # Only texts with a candidate move on: all texts are shuffled once. Joins with texts are merge joins at every
    # size, since what is on the other side grows with the corpus.
    ids = met.select(F.col("a").alias("id")).unionByName(met.select(F.col("b").alias("id"))).distinct()
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi"), n, 10_000)
    links = stored(verified(first, texts, k, percent), pairs, 4_000)
    groups = components(links, pairs)

    found = _across(met, pairs, groups, texts, k, percent, part)
    if found is not None:
        groups = components(links.unionByName(found), pairs)
    # copies of a class go where their representative goes
    groups = stored(groups, n)
    led = same.join(groups.select(F.col("id").alias("a"), "component"), "a", "left").select(F.col("b").alias("id"), F.least("a", F.coalesce("component", "a")).alias("component")).distinct()
    led = stored(led.unionByName(groups).groupBy("id").agg(F.min("component").alias("component")), n)
    out = signed.select("doc_id", "n_shingles").join(led.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
