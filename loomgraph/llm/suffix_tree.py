"""Language-model scoring with a probabilistic suffix tree over the bytes of texts.

Counting covers all training texts: each task counts its (DEPTH + 1)-byte windows and its words by vectorised
sorting, and sums meet in a shuffle. A context of up to DEPTH bytes becomes a state if it was seen LEAST times and
its next-byte distribution diverges from its parent's by GAIN; suffixes of states are states. Both bounds are fixed
numbers, so a larger corpus keeps more states. Distributions are smoothed from the shorter contexts down to a
uniform one (Witten-Bell). Smoothing, divergence tests and pruning are joins, level by level: nothing but finished
states leaves the executors. A text's score is the sum of its bytes' log10 probabilities, each given the longest
state before it.

A tree of at most BROADCAST entries (16 bytes each on the way, 24 in a worker) is sent to the workers; a larger one
stays distributed, and the windows of texts are joined with it. Both ways give the same scores.

Texts are scored in normal form: A-Z in lower case, words joined by single spaces, then an end symbol.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept, ready_workers, stored
from loomgraph.llm.words import word_hashes

_U = np.uint64
DEPTH = 5  # bytes of context at most; codes of windows fit 48 bits
START, END = 0xFE, 0xFF  # bytes that UTF-8 doesn't have
#: A state's context was seen so often at least, and gains so many nats over its parent over its whole count.
LEAST, GAIN = 32, 6.0
#: States and arcs that are broadcast at most.
BROADCAST = 4_000_000
#: Words whose counts travel to all workers; rarer ones are looked up by a join.
FREQUENT = 1 << 17
#: Bytes counted between two reductions of a task, and distinct windows after which it hands on.
CHUNK, HELD = 1 << 22, 1 << 21
_SPACE = bytes.maketrans(bytes(range(9, 14)), b"     ")


def normal(text: str | None) -> bytes:
    """Lower-case A-Z, words joined by single spaces."""
    return b" ".join(w for w in (text or "").encode("utf-8", "surrogatepass").translate(_SPACE).lower().split(b" ") if w)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of the texts, the code of the DEPTH bytes before it and itself; and the texts' cuts."""
    lead = bytes([START]) * DEPTH
    a = np.frombuffer(b"".join(lead + t + bytes([END]) for t in texts), np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    code = np.zeros(max(0, len(a) - DEPTH), _U)
    for j in range(DEPTH + 1):
        code = (code << _U(8)) | a[j : len(a) - DEPTH + j].astype(_U)
    keep = np.ones(len(code), bool)
    ends = np.cumsum(size + DEPTH)[:-1]  # where the next text's lead begins
    for j in range(DEPTH):
        keep[ends - DEPTH + j] = False
    return code[keep], np.cumsum(size)


def _reduce(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


class _Counts:
    """Counts of 64-bit keys with bounded memory."""

    def __init__(self) -> None:
        self.new: list[np.ndarray] = []
        self.size = 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.size += len(keys)
        if self.size >= CHUNK // 4:
            self.fold()

    def fold(self) -> None:
        if self.new:
            k, c = np.unique(np.concatenate(self.new), return_counts=True)
            self.keys.append(k)
            self.counts.append(c)
            self.new, self.size = [], 0
            if len(self.keys) > 6:
                k, c = _reduce(self.keys, self.counts)
                self.keys, self.counts = [k], [c]

    def handed(self, everything: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if everything:
            self.fold()
        if self.keys and (everything or sum(map(len, self.keys)) > HELD):
            yield _reduce(self.keys, self.counts)
            self.keys, self.counts = [], []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (kind, key, n): kind 0 for hashes of words, 1 for windows."""
    kept()
    words, grams = _Counts(), _Counts()

    def rows(everything: bool) -> Iterator[pa.RecordBatch]:
        for kind, c in ((0, words), (1, grams)):
            for k, n in c.handed(everything):
                for i in range(0, len(k), 1 << 18):
                    part = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), kind, np.int32)), pa.array(k[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["kind", "key", "n"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for _, h in word_hashes(texts):
            words.add(h)
        held: list[bytes] = []
        for t in texts:
            held.append(normal(t))
            if sum(map(len, held[-64:])) > CHUNK // 8 or len(held) >= 64:
                grams.add(windows(held)[0])
                held = []
        if held:
            grams.add(windows(held)[0])
        yield from rows(False)
    yield from rows(True)


class Lookup:
    """Open-addressing table from 63-bit keys to single-precision values, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, np.nan, np.float32)
        left, values = keys.view(np.int64), values.astype(np.float32)
        at = self._home(keys)
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left  # two keys may have asked for one slot
            self.value[at[~lost]] = values[~lost]
            left, values, at = left[lost], values[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN if it isn't there."""
        want, at = keys.view(np.int64), self._home(keys)
        got = self.slots[at]
        out = np.where(got == want, self.value[at], np.float32(np.nan))
        left = np.flatnonzero((got != want) & (got != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            hit = got == want[left]
            out[left[hit]] = self.value[at[hit]]
            on = ~hit & (got != -1)
            left, at = left[on], at[on]
        return out


def _tag(codes: np.ndarray, length: int) -> np.ndarray:
    """Codes of length bytes, told apart from those of other lengths."""
    return codes | _U((length + 1) << 49)


def _tagged(code: Column, length: int) -> Column:
    """The same as _tag of the last length bytes of a code, as a column."""
    return code.bitwiseAND(F.lit((1 << 8 * length) - 1)).bitwiseOR(F.lit((length + 1) << 49))


class Tree:
    """States with smoothed next-byte distributions: states (tagged contexts) with the log10 weight of what they have
    not seen; arcs (tagged windows) with the log10 probability of their last byte."""

    def __init__(self, states: np.ndarray, weight: np.ndarray, arcs: np.ndarray, logp: np.ndarray):
        self.states, self.arcs = Lookup(states, weight), Lookup(arcs, logp)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window given the longest state before it."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        for d in range(DEPTH, -1, -1):
            if not len(left):
                break
            c = codes[left] & _U((1 << 8 * (d + 1)) - 1)
            logp = self.arcs.get(_tag(c, d + 1))
            hit = ~np.isnan(logp)
            out[left[hit]] += logp[hit]
            left, c = left[~hit], c[~hit]
            weight = self.states.get(_tag(c >> _U(8), d))
            known = ~np.isnan(weight)
            out[left[known]] += weight[known]
        out[left] += -np.log10(256.0)
        return out


def build(gram_counts: DataFrame, least: int = LEAST, gain: float = GAIN) -> tuple[DataFrame, DataFrame]:
    """(states(key, value), arcs(key, value)) of the tree, from gram_counts(key, n) of all windows: see Tree."""
    levels = [F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("code")) for d in range(DEPTH + 1)]
    rows = (DEPTH + 1) * gram_counts.count()
    arcs = stored(gram_counts.select("n", F.explode(F.array(*levels)).alias("a")).groupBy("a.d", "a.code").agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("code", 8)), rows)
    contexts = arcs.groupBy("d", "context").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("kinds")).where(F.col("t") >= max(2, least))
    arcs = stored(arcs.join(contexts, ["d", "context"]), rows)
    rows = arcs.count()
    # smoothed probabilities from the shortest contexts up: an arc's last d bytes are an arc of depth d - 1
    smooth = (F.col("n") + F.col("kinds") * F.col("parent")) / (F.col("t") + F.col("kinds"))
    below, per = None, []
    for d in range(DEPTH + 1):
        own = arcs.where(F.col("d") == d)
        if below is None:
            own = own.withColumn("parent", F.lit(1 / 256))
        else:
            own = own.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * d) - 1))).join(below.select(F.col("code").alias("suffix"), F.col("p").alias("parent")), "suffix")
        below = stored(own.withColumn("p", smooth).select("context", "code", "n", "t", "kinds", "parent", "p"), rows)
        per.append(below)
    # pruning from the longest down: a context stays if it diverges or a longer state ends with it
    states, kept, need = [], [], None
    weight = F.log10(F.first("kinds") / (F.first("t") + F.first("kinds"))).cast("float")
    for d in range(DEPTH, -1, -1):
        worth = F.lit(d == 0) | (F.sum(F.col("n") * F.log(F.col("p") / F.col("parent"))) >= gain)
        own = per[d].groupBy("context").agg(worth.alias("worth"), weight.alias("value"))
        if need is not None:
            own = own.join(need.withColumn("needed", F.lit(True)), "context", "left").withColumn("worth", F.col("worth") | F.coalesce("needed", F.lit(False)))
        own = stored(own.where("worth").select("context", "value"), rows)
        states.append(own.select(_tagged(F.col("context"), d).alias("key"), "value"))
        kept.append(per[d].join(own.select("context"), "context", "left_semi").select(_tagged(F.col("code"), d + 1).alias("key"), F.log10("p").cast("float").alias("value")))
        need = own.select(F.col("context").bitwiseAND(F.lit((1 << 8 * max(0, d - 1)) - 1)).alias("context")).distinct()
    return stored(reduce(DataFrame.unionByName, states), rows), stored(reduce(DataFrame.unionByName, kept), rows)


def arrays(states: DataFrame, arcs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What makes a Tree, on the driver."""
    got = [t.toArrow() for t in (states, arcs)]
    return tuple(v for t in got for v in (t.column("key").to_numpy().astype(np.int64).view(_U), t.column("value").to_numpy().astype(np.float32)))


def log_probabilities(codes: DataFrame, states: DataFrame, arcs: DataFrame) -> DataFrame:
    """(code, logp) of the distinct windows codes(code), as Tree.score has them, by joins with the tree."""
    depths = [F.struct(F.lit(d).alias("d"), _tagged(F.col("code"), d + 1).alias("arc"), _tagged(F.shiftright(F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)), 8), d).alias("state")) for d in range(DEPTH + 1)]
    asked = codes.select("code", F.explode(F.array(*depths)).alias("x")).select("code", "x.*")
    met = asked.join(arcs.toDF("arc", "logp"), "arc", "left").join(states.toDF("state", "weight"), "state", "left")
    found = met.groupBy("code").agg(F.max(F.when(F.col("logp").isNotNull(), F.struct("d", "logp"))).alias("best"), F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("d", "weight"))).alias("weights"))  # DEPTH + 1 at most
    top, last = F.coalesce(F.col("best.d"), F.lit(-1)), F.coalesce(F.col("best.logp").cast("double"), F.lit(-math.log10(256)))
    return found.select("code", F.aggregate(F.filter("weights", lambda w: w["d"] > top), last, lambda a, w: a + w["weight"].cast("double")).alias("logp"))


def _shared(tree: Broadcast | None, frequent: Broadcast) -> tuple[Tree | None, np.ndarray, np.ndarray]:
    """The worker's tree and frequent words for these broadcasts, kept between its tasks."""
    own = tree.value if tree is not None else (np.zeros(0, _U),) * 4
    key = ("tree", own[0].tobytes()[:4096], frequent.value[0].tobytes()[:4096], len(own[0]), len(own[2]), float(own[3].sum(dtype=np.float64)), float(frequent.value[1].sum()))
    return kept(key, lambda: (Tree(*own) if tree is not None else None, *frequent.value))


def _scored(batches: Iterator[pa.RecordBatch], tree: Broadcast | None, frequent: Broadcast, scale: float) -> Iterator[pa.RecordBatch]:
    """(row, text, with) to rows of three kinds: 0, a text's own (n tokens, known, base, score); 1, each of its rare
    words (key, n); 2, without a tree, each of its windows (key, n)."""
    t, keys, counts = _shared(tree, frequent)
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        n, known, base, score = (np.zeros(len(ids), k) for k in (np.int64, np.int64, float, float))
        more: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def asked(kind: int, row: int, found: np.ndarray, more: list = more) -> None:
            if len(found):
                more.append((kind, row, *np.unique(found, return_counts=True)))

        for i, h in word_hashes(texts):
            n[i] = len(h)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            known[i] = hit.sum()
            base[i] = np.log10((counts[at[hit]] + 1) / scale).sum()
            asked(1, ids[i], h[~hit])
        i = 0
        while i < len(texts):
            j, held, size = i, [], 0
            while j < len(texts) and (not held or size < CHUNK // 16):
                held.append(normal(texts[j]))
                size += len(held[-1])
                j += 1
            code, cut = windows(held)
            if t is None:
                for k, part in enumerate(np.split(code, cut[:-1])):
                    asked(2, ids[i + k], part)
            else:
                score[i:j] = np.add.reduceat(t.score(code), np.r_[0, cut[:-1]])
            i = j
        size = [len(m[2]) for m in more]
        k = sum(size)
        kind, row = (np.repeat(np.array([m[c] for m in more], np.int64), size) for c in (0, 1))
        key, count = (np.concatenate([m[c] for m in more]) if more else np.zeros(0, np.int64) for c in (2, 3))
        none = np.zeros(k)
        columns = [np.r_[ids, row].astype(np.int64), np.r_[np.zeros(len(ids), np.int32), kind].astype(np.int32), np.r_[np.zeros(len(ids), np.int64), key.astype(_U).view(np.int64)], np.r_[n, count].astype(np.int64), np.r_[known, none].astype(np.int64), np.r_[base, none], np.r_[score, none]]
        others = batch.column(2)
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.concat_arrays([others, pa.nulls(k, others.type)])], ["row", "kind", "key", "n", "known", "base", "score", "with"])


def learn(texts: DataFrame) -> DataFrame:
    """(kind, key, n): counts of all words (kind 0) and windows (kind 1) of texts(text)."""
    ready_workers(texts.sparkSession)
    return stored(texts.select("text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))


def score(docs: DataFrame, training: DataFrame, least: int = LEAST, gain: float = GAIN, broadcast: int = BROADCAST) -> DataFrame:
    """The columns of docs but text, with n_tokens, n_known, train_tokens, base_score and score.

    training(text) is what is learned from; docs(text, ...) is scored. Null texts are empty: one token, the end.
    Whole texts are read. Repeated rows get equal rows; an empty docs table gives an empty one, an empty training
    table base probabilities of 1 and uniform bytes. Columns of docs that are named like a result are replaced.
    """
    spark = docs.sparkSession
    counts = learn(training)
    ends = training.count()
    words = counts.where("kind = 0")
    types, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, types = tokens + ends, types + (ends > 0)
    scale = float(tokens + types + 1)
    states, arcs = build(counts.where("kind = 1").select("key", "n"), least, gain)
    small = states.count() + arcs.count() <= broadcast
    tree = spark.sparkContext.broadcast(arrays(states, arcs)) if small else None
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys, n = top.column("key").to_numpy().astype(np.int64).view(_U), top.column("n").to_numpy()
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], n[order].astype(float)))

    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c != "text" and c not in made]
    ready_workers(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(F.lit(0).alias("row__"), *(F.col(f"`{c}`") for c in others)).alias("with"))
    own = stored(rows.mapInArrow(partial(_scored, tree=tree, frequent=frequent, scale=scale), f"row long, kind int, key long, n long, known long, base double, score double, with {rows.schema['with'].dataType.simpleString()}"))
    met = own.where("kind = 1").select("row", "key", "n").join(words.select("key", F.col("n").alias("c")), "key", "left")
    more = met.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known2"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / scale)).alias("base2"))
    out = own.where("kind = 0").join(more, "row", "left")
    total = F.col("score")
    if not small:
        asked = own.where("kind = 2").select("row", F.col("key").alias("code"), "n")
        known = stored(log_probabilities(asked.select("code").distinct(), states, arcs))
        out = out.join(asked.join(known, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("score2")), "row", "left")
        total = F.coalesce("score2", F.lit(0.0))
    end = float(np.log10((ends + 1) / scale))
    return out.select(
        *(F.col(f"with.`{c}`") for c in others), (F.col("n") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("known2", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0)) + end).alias("base_score"), total.alias("score"))
