"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking by exact cosine.

A rotation is learned on a bounded sample (``sample`` vectors): principal axes, then alternating between binary
codes and the orthogonal matrix that fits them best. Several rotations from different starts give ``tables``
substrings of ``bits`` bits; both follow from what links of the sample look like and from the number of vectors.
Two vectors meet if they agree in one whole substring. Equal vectors are one class before that. Within a bucket
vectors are compared in blocks by matrix products in double precision, and a pair counts in the first table
where it meets, so no pair is emitted or kept: a block gives a number of links for each vector and a forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ready_workers, stored
from loomgraph.llm.components import components

SAMPLE, BLOCK = 4096, 512
#: Rough seconds that a row costs in each table, and that a compared pair costs.
ROW_COST, PAIR_COST = 1e-5, 1e-7


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) by iterative quantisation of the rows of x."""
    d = x.shape[1]
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T) if len(x) > 1 else np.eye(d))
    v = (x - mean) @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    for _ in range(rounds):
        code = np.where(v @ r >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(code.T @ v)
        r = (a @ b).T
    return mean, axes @ r


def learn_tables(x: np.ndarray, tables: int, bits: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """One (mean, projection to bits) for each table; a rotation serves as many tables as its bits allow."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(out) < tables:
        mean, p = learn_rotation(x, seed + len(out))
        order = np.random.default_rng(seed + len(out)).permutation(p.shape[1])
        for i in range(0, max(1, p.shape[1] - bits + 1), max(1, bits)):
            if len(out) < tables:
                out.append((mean, p[:, order[i : i + bits]]))
    return out


def _signs(x: np.ndarray, learned: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([((x - m) @ p) >= 0 for m, p in learned], axis=1)


def sampled_pairs(x: np.ndarray, label: np.ndarray, threshold: float, seed: int = 13, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of x, rows of x) of one label: those at the threshold or above, and any; at most ``most`` each, drawn evenly."""
    linked, other = [], []
    for name in np.unique(label):
        at = np.flatnonzero(label == name)
        i, j = np.triu_indices(len(at), 1) if len(at) <= 2048 else np.random.default_rng(seed).integers(0, len(at), (2, 1 << 21))
        i, j = at[i[i != j]], at[j[i != j]]
        for k in range(0, len(i), 1 << 18):
            hit = np.einsum("ij,ij->i", x[i[k : k + (1 << 18)]], x[j[k : k + (1 << 18)]]) >= threshold
            linked.append(np.stack([i[k : k + (1 << 18)][hit], j[k : k + (1 << 18)][hit]], axis=1))
        other.append(np.stack([i, j], axis=1)[:: max(1, len(i) // most)])
    rng = np.random.default_rng(seed)
    draw = lambda v: v if len(v) <= most else v[rng.choice(len(v), most, replace=False)]
    none = [np.zeros((0, 2), np.int64)]
    return draw(np.concatenate(linked or none)), draw(np.concatenate(other or none))


def tables_needed(lost: np.ndarray, miss: float) -> int:
    """The least number of tables that misses with mean probability ``miss`` the pairs that one table misses with ``lost``."""
    low, high = 0, 1
    while (lost**high).mean() > miss and high < 1 << 20:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if (lost**mid).mean() <= miss else (mid, high)
    return high


def plan_codes(x: np.ndarray, label: np.ndarray, rows: int, pairs: float, threshold: float, miss: float, bits: int | None = None, seed: int = 13) -> tuple[int, int]:
    """(bits, tables): the cheapest that misses a link with probability ``miss``, for so many rows and pairs of one label.

    ``bits`` fixes the width.

    How often a bit differs depends on the data, since codes are centred. It is measured on pairs of the sample x
    that are links, and on its vectors with copies turned to the threshold in random directions; never taken as
    less than for planes through the origin. The wider the codes, the more tables, and the fewer pairs meet in
    each; where links differ in half of the bits, no bits at all (one table, every pair of a label) are cheapest.
    """
    least = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    learned = learn_tables(x, max(1, math.ceil(256 / x.shape[1])), x.shape[1])
    own = _signs(x, learned)
    linked, other = sampled_pairs(x, label, threshold, seed)
    rng = np.random.default_rng(seed)
    part, copies = x[:512], 16
    turned = np.zeros(len(part))
    for _ in range(copies):
        u = rng.standard_normal(part.shape)
        u -= (u * part).sum(axis=1, keepdims=True) * part
        u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
        turned += (_signs(threshold * part + math.sqrt(max(0.0, 1 - threshold * threshold)) * u, learned) != own[:512]).mean(axis=1) / copies
    apart = [np.maximum(v, least) for v in (turned, (own[linked[:, 0]] != own[linked[:, 1]]).mean(axis=1)) if len(v)]
    meet = 1 - (own[other[:, 0]] != own[other[:, 1]]).mean(axis=1) if len(other) else np.ones(1)
    best = (math.inf, 0, 1)
    for width in range(min(x.shape[1], 24) + 1) if bits is None else [min(bits, x.shape[1])]:
        tables = max(tables_needed(1 - (1 - a) ** width, miss) for a in apart)
        best = min(best, (tables * (rows * ROW_COST + pairs * float((meet**width).mean()) * PAIR_COST), width, tables))
    return best[1:]


def substrings(x: np.ndarray, learned: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The code of each row of x in each table, as integers."""
    return np.stack([(((x - m) @ p) >= 0) @ (1 << np.arange(p.shape[1], dtype=np.int64)) for m, p in learned], axis=1)


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1 and whether they take part: finite, not null, not zero, of the first's dimension."""
    good = [r is not None and len(r) > 0 and all(v is not None for v in r) for r in rows]
    d = next((len(r) for r, g in zip(rows, good, strict=True) if g), 1)
    x = np.array([r if g and len(r) == d else [0.0] * d for r, g in zip(rows, good, strict=True)], np.float64).reshape(len(rows), d)
    ok = np.isfinite(x).all(axis=1)
    x[~ok] = 0
    top = np.abs(x).max(axis=1, initial=0)
    x = x / np.where(top > 0, top, 1)[:, None]  # no overflow or underflow in the squares
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.where(size > 0, size, 1)[:, None], ok & (size > 0)


def _encode(batches: Iterator[pa.RecordBatch], learned: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, _ = _unit(batch.column(2).to_pylist())
        codes = substrings(x, learned) if len(x) else np.zeros((0, len(learned)), np.int64)
        at = pa.array(np.arange(0, codes.size + 1, len(learned), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(codes.reshape(-1)))], [*batch.schema.names, "codes"])


class _Forest:
    """Links of one group as counts, and as edges that join what is not yet joined."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.a: list[int] = []
        self.b: list[int] = []

    def find(self, v: int) -> int:
        root = self.root
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    def add(self, us: np.ndarray, vs: np.ndarray) -> None:
        for u, v in zip(us.tolist(), vs.tolist(), strict=True):
            if (p := self.find(u)) != (q := self.find(v)):
                self.root[p] = q
                self.a.append(u)
                self.b.append(v)


def _small(x: np.ndarray, group: np.ndarray, codes: np.ndarray, t: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked row pairs inside runs of equal group: every row with the 1st, 2nd, ... next of its run."""
    left, right = [], []
    for step in range(1, len(group)):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            break
        hit = i[np.einsum("ij,ij->i", x[i], x[i + step]) >= threshold]
        left.append(hit)
        right.append(hit + step)
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    earlier = (codes[a] == codes[b]) & (np.arange(codes.shape[1]) < t[a][:, None])
    new = ~earlier.any(axis=1)  # else met in an earlier table
    return a[new], b[new]


def _blocks(x, cx, ix, nx, y, cy, iy, ny, same: bool, t: int, threshold: float, forest: _Forest, gain: dict[int, int]) -> None:
    """Links between two sides of a large group, block by block."""
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            hit = x[i : i + BLOCK] @ y[j : j + BLOCK].T >= threshold
            if same and i == j:
                hit = np.triu(hit, 1)
            a, b = np.nonzero(hit)
            new = ~(cx[i + a, :t] == cy[j + b, :t]).any(axis=1)
            a, b = i + a[new], j + b[new]
            forest.add(ix[a], iy[b])
            for ids, at, n in ((ix, a, ny[b]), (iy, b, nx[a])):
                if len(at):
                    total = np.bincount(at - at.min(), n)
                    for k in np.flatnonzero(total).tolist():
                        v = int(ids[k + at.min()])
                        gain[v] = gain.get(v, 0) + int(total[k])


def _numbered(rows: pa.Table) -> np.ndarray:
    """The labels of some rows as numbers."""
    return rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()


def _links(batches: Iterator[pa.RecordBatch], threshold: float, part: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (bucket and pair of parts) to (a, -1, links of a) and forest edges (a, b, 0).

    A group waits until its last row: at most 2 * part rows, more only by chance of the hash.
    """
    def finished(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        d = {n: rows.column(n).to_numpy() for n in ("rep", "copies", "t", "code", "part", "low", "high")}
        d["label"] = _numbered(rows)
        x, _ = _unit(rows.column("embedding").to_pylist())
        codes = rows.column("codes").combine_chunks().values.to_numpy().reshape(len(x), -1)
        key = np.stack([d[n] for n in ("label", "t", "code", "low", "high")], axis=1)
        group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).any(axis=1)]) if len(x) else np.zeros(0, np.int64)
        size = np.bincount(group, minlength=1)[group]
        whole = d["low"] == d["high"]
        forest, gain = _Forest(), {}
        few = np.flatnonzero(whole & (size > 1) & (size <= 32))
        a, b = _small(x[few], group[few], codes[few], d["t"][few], threshold)
        a, b = few[a], few[b]
        more = np.bincount(a, d["copies"][b], len(x)) + np.bincount(b, d["copies"][a], len(x))
        pairs = (d["rep"][a], d["rep"][b])
        for g in np.unique(group[(size > 32) | ~whole]).tolist():
            at = np.arange(np.searchsorted(group, g), np.searchsorted(group, g, "right"))
            same, t = bool(whole[at[0]]), int(d["t"][at[0]])
            mine = at if same else at[d["part"][at] == d["low"][at]]
            other = at if same else at[d["part"][at] == d["high"][at]]
            side = lambda r: (x[r], codes[r], d["rep"][r], d["copies"][r])
            _blocks(*side(mine), *side(other), same, t, threshold, forest, gain)
        has = np.flatnonzero(more)
        ids = np.concatenate([d["rep"][has], np.fromiter(gain, np.int64, len(gain))])
        n = np.concatenate([more[has].astype(np.int64), np.fromiter(gain.values(), np.int64, len(gain))])
        ea, eb = np.concatenate([pairs[0], np.array(forest.a, np.int64)]), np.concatenate([pairs[1], np.array(forest.b, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, ea]).astype(np.int64)), pa.array(np.concatenate([np.full(len(ids), -1), eb]).astype(np.int64)), pa.array(np.concatenate([n, np.zeros(len(ea), np.int64)]))], ["a", "b", "n"])

    waiting: list[pa.Table] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]))
        held += batch.num_rows
        if held < 2 * part:
            continue
        rows = pa.concat_tables(waiting)
        key = np.stack([_numbered(rows), *(rows.column(n).to_numpy() for n in ("t", "code", "low", "high"))], axis=1)
        last = np.flatnonzero((key != key[-1]).any(axis=1))
        if not len(last):
            waiting = [rows]
            continue
        cut = int(last[-1]) + 1
        yield from finished(rows.slice(0, cut))
        waiting, held = [rows.slice(cut)], len(rows) - cut
    if waiting:
        yield from finished(pa.concat_tables(waiting))


def _found(classes: DataFrame, rows: int, pairs: float, threshold: float, miss: float, bits: int | None, sample: int, part: int) -> DataFrame:
    """Links and forest edges (see _links) among classes of one dimension, so many with so many pairs of one label."""
    drawn = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding", "label").collect()  # bounded by sample
    x, _ = _unit([r[0] for r in drawn])
    label = np.array([r[1] for r in drawn])
    width, tables = plan_codes(x, label, rows, pairs, threshold, miss, bits)
    learned = learn_tables(x, tables, width)
    coded = stored(classes.select("rep", "label", "embedding", "copies").mapInArrow(partial(_encode, learned=learned), "rep long, label string, embedding array<double>, copies long, codes array<long>"), rows, 20_000)
    bucket = ["label", "t", "code"]
    large = stored(coded.select("label", F.posexplode("codes").alias("t", "code")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > part), rows * tables // part)
    placed = coded.select("rep", "label", "copies", "embedding", "codes", F.posexplode("codes").alias("t", "code")).join(large, bucket, "left").withColumn("parts", F.coalesce(F.ceil(F.col("members") / part), F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    # a vector of part p goes to every pair of parts with p in it
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("rep", "copies", "embedding", "codes", *bucket, "part", F.least("part", "q").alias("low"), F.greatest("part", "q").alias("high"))
    grouped = placed.repartition(*bucket, "low", "high").sortWithinPartitions(*bucket, "low", "high")
    return stored(grouped.mapInArrow(partial(_links, threshold=threshold, part=part), "a long, b long, n long"), rows * tables, 20_000)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4, bits: int | None = None, sample: int = SAMPLE, part: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Only vectors of one label are compared. Null, zero, empty or non-finite vectors and null labels link with
    nothing. Vectors are compared with those of their own dimension. Rows with a null id or that share one are
    returned; a null id links with nothing. Equal vectors link at any threshold and count as links of each other.
    An empty table gives an empty one. Other columns are not read, whatever their names.

    Bits and tables are the cheapest that miss a link with probability ``miss``, measured on the sample (plan_codes);
    ``bits`` fixes the width. A bucket of more than ``part`` vectors is dealt in parts by a hash, and pairs of parts
    are compared, so that no task gathers a bucket.
    """
    ready_workers(vectors.sparkSession, 4096)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    good = good.withColumn("embedding", F.transform("embedding", lambda v: v + 0.0))  # -0.0 and 0.0 alike
    number = vectors.count()
    classes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), number, 20_000)
    several = classes.where("copies > 1")
    same = good.join(several.select("label", "embedding", "rep", "copies"), ["label", "embedding"]).select("vec_id", "rep", "copies")
    same = stored(same.unionByName(classes.where("copies = 1").select(F.col("rep").alias("vec_id"), "rep", "copies")), number)
    # vectors of different dimensions have no cosine: each dimension has its own rotations and tables
    n = F.col("n").cast("double")
    dims = classes.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.sum("n").alias("rows"), F.sum(n * (n - 1) / 2).alias("pairs")).where("pairs > 0").orderBy("dim").collect()
    each = [_found(classes.where(F.size("embedding") == r["dim"]), r["rows"], r["pairs"], threshold, miss, bits, sample, part) for r in dims]
    if each:
        found = reduce(DataFrame.unionByName, each)
        links = found.where("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
        groups = components(found.where("b <> -1").select("a", "b"), found.count()).withColumnRenamed("id", "rep")
        same = same.join(stored(links, number), "rep", "left").join(stored(groups, number), "rep", "left")
    else:
        same = same.withColumn("more", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    known = same.select(F.col("vec_id").alias("id"), (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(stored(known, number), F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
