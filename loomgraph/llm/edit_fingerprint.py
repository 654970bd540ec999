"""Document fingerprints by randomised edit embedding (shared random walks), bit sampling, banding, verification.

A walk reads a text: at every step it emits the character it stands on and moves on or stays, by a random bit
that all texts share for the step and the character. Texts a few edits apart fall into step again, so the
emitted strings differ in few places. The fingerprint keeps a random bit of the emitted character at sampled
steps: OCTAVE of them among the first OCTAVE steps and in every doubling after that. Likeness weighs the octaves
by their length, so it estimates how much of two whole walks agrees, whatever the size of the texts.

Bands are keys of a few of these bits, drawn from windows that a walk has wholly read, so the padding after a text's
end is in no key. Texts that share a band are candidates, and likeness verifies them. Bits a band grow with the
logarithm of the number of texts and bands with what likeness and miss then ask for (plan_bands), so texts that
have nothing in common seldom meet, however many there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept, ready_workers, stored
from loomgraph.llm.components import components
from loomgraph.llm.words import mix

#: Shared random bits repeat after PERIOD steps. A text's last quarter (1 / PART) is edited.
PERIOD, OCTAVE, PART, SEED = 1024, 128, 4, 20
PAD = 256  # stands for the characters after a text's end
#: Levels of a text that give bands; bits a band and bands a level where the number of texts is not asked for.
LEVELS, BITS, BANDS = 3, 20, 27
MOST_BANDS = 1024


class Walker:
    """Shared randomness: the moves as a table of rows that lead to rows, and the sampled steps and bits."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        moves = rng.integers(0, 2, (PERIOD, 256), np.uint8)
        moves[0] = 1  # no character stays for a whole period
        # state j, character c: the state after the first step at or after j where the walk moves on from c
        after = np.zeros((2 * PERIOD + 1, 256), np.int64)
        for j in range(2 * PERIOD - 1, -1, -1):
            after[j] = np.where(moves[j % PERIOD] == 1, j + 1, after[j + 1])
        after = after[:PERIOD] % PERIOD
        self.table: list[list] = [[None] * 257 for _ in range(PERIOD)]
        for j, row in enumerate(self.table):
            row[:256] = [self.table[k] for k in after[j].tolist()]
            row[256] = j
        self.seed = seed
        self.samples: list[tuple[np.ndarray, np.ndarray]] = []
        self.places: dict[tuple[int, int, int], tuple[int, np.ndarray, np.ndarray]] = {}

    def sample(self, octave: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps sampled in an octave, in order, and the bit of each character (and PAD) at each."""
        while len(self.samples) <= octave:
            k = len(self.samples)
            rng = np.random.default_rng([self.seed, k])
            low = OCTAVE << (k - 1) if k else 0
            steps = np.arange(OCTAVE) if k <= 1 else rng.integers(0, low, OCTAVE)
            self.samples.append((np.sort(steps) + low, rng.integers(0, 2, (OCTAVE, 257), np.uint8)))
        return self.samples[octave]

    @staticmethod
    def classes(text: str) -> bytes:
        """One byte for each code point: itself below 256, else a hash."""
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(a < 256, a, (a * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()

    def states(self, codes: bytes, start: int = 0) -> np.ndarray:
        """State before each character and after the last."""
        return np.fromiter(map(itemgetter(256), accumulate(codes, getitem, initial=self.table[start])), np.int16, len(codes) + 1)

    def print(self, codes: bytes, states: np.ndarray) -> Print:
        stay = np.diff(states.astype(np.int64)) % PERIOD
        stay[stay == 0] = PERIOD
        ends = np.cumsum(stay)
        total = int(ends[-1]) if len(ends) else 0
        emitted = np.concatenate((np.frombuffer(codes, np.uint8).astype(np.int64), [PAD]))
        bits, k = [], 0
        while total and (k == 0 or OCTAVE << (k - 1) < total):
            steps, bit = self.sample(k)
            bits.append(bit[np.arange(OCTAVE), emitted[np.searchsorted(ends, steps, "right")]])
            k += 1
        return Print(total, np.stack(bits) if bits else np.zeros((0, OCTAVE), np.uint8))

    @staticmethod
    def levels(steps: int) -> range:
        """The last LEVELS windows that a walk of so many steps has read: the first 1, 2, 4, ... OCTAVE steps, then the
        first half of each octave. Walks that are alike enough have at least all but one of them in common."""
        first = OCTAVE.bit_length()  # windows inside the first octave
        n = min(steps, OCTAVE).bit_length()
        while n >= first and 2 * steps >= 3 * (OCTAVE << (n - first)):
            n += 1
        return range(max(0, n - LEVELS), n)

    def bands(self, p: Print, bands: int, bits: int) -> np.ndarray:
        """Keys of a fingerprint's bands: level, number of the band and the bits it samples."""
        chosen = [self._band(level, bands, bits) for level in self.levels(p.steps)]
        if not chosen:
            return np.zeros(0, np.int64)
        sums = np.concatenate([p.bits[octave].astype(float) @ pick for octave, pick, _ in chosen])
        return mix(sums.astype(np.uint64) ^ np.concatenate([salt for *_, salt in chosen])).view(np.int64)

    def _band(self, level: int, bands: int, bits: int) -> tuple[int, np.ndarray, np.ndarray]:
        """A level's octave, the powers of two (exact in doubles) by which each band sums its bits, and each band's salt."""
        if (level, bands, bits) not in self.places:
            octave = max(0, level + 1 - OCTAVE.bit_length())
            inside = np.flatnonzero(self.sample(octave)[0] < ((OCTAVE << (octave - 1)) * 3 // 2 if octave else 1 << level))
            rng, n = np.random.default_rng([self.seed, level, bands, bits]), min(bits, len(inside))
            pick = np.zeros((OCTAVE, bands if n < len(inside) else 1))
            for k in range(pick.shape[1]):
                pick[rng.choice(inside, n, replace=False), k] = 2.0 ** np.arange(n)
            self.places[level, bands, bits] = octave, pick, mix(np.arange(pick.shape[1], dtype=np.uint64) + np.uint64(level << 32))
        return self.places[level, bands, bits]

    def read(self, text: str | None) -> Print:
        codes = self.classes(text or "")
        return self.print(codes, self.states(codes))

    def likeness(self, a: Print, b: Print) -> float:
        """0 to 1: how much more of the walks' sampled bits agree than by chance; 1 for equal fingerprints."""
        total = max(a.steps, b.steps)
        if not total:
            return 1.0
        if a.steps == b.steps and np.array_equal(a.bits, b.bits):
            return 1.0
        agree = 0.0
        for k in range(max(len(a.bits), len(b.bits))):
            if k >= min(len(a.bits), len(b.bits)):
                break  # only one walk gets here: chance agreement, which counts as none
            low = OCTAVE << (k - 1) if k else 0
            high = OCTAVE << k if k else OCTAVE
            inside = self.sample(k)[0] < total
            if inside.any():
                agree += (min(high, total) - low) * (2 * float((a.bits[k] == b.bits[k])[inside].mean()) - 1)
        return min(1.0, max(0.0, agree / total))


class Print:
    """A fingerprint: steps of the walk and OCTAVE sampled bits an octave."""

    def __init__(self, steps: int, bits: np.ndarray):
        self.steps, self.bits = steps, bits

    def __str__(self) -> str:
        return f"{self.steps:x}:{np.packbits(self.bits).tobytes().hex()}"

    @staticmethod
    def parse(s: str) -> Print:
        steps, _, data = s.partition(":")
        return Print(int(steps, 16), np.unpackbits(np.frombuffer(bytes.fromhex(data), np.uint8)).reshape(-1, OCTAVE))


def plan_bands(texts: int, least: float, miss: float) -> tuple[int, int]:
    """(bits a band, bands a level) for so many texts: a chance meeting in a band is rarer than one a text, and texts of
    likeness ``least`` on two common levels share no band with probability ``miss``. A least likeness that would ask
    for more than MOST_BANDS is an error."""
    bits = min(40, max(12, math.ceil(math.log2(max(1, texts))) + 4))
    agree = min(0.99, (1 + least) / 2) ** bits
    bands = max(1, math.ceil(math.log(miss) / math.log1p(-agree) / 2))
    if bands > MOST_BANDS:
        raise ValueError(f"a likeness of {least} asks for {bands} bands a level among {texts} texts; {MOST_BANDS} at most")
    return bits, bands


def walker(seed: int = SEED) -> Walker:
    return kept(("walker", seed), lambda: Walker(seed))


#: What is said of a document and the one after it.
_MADE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long, bands_next long"
_NAMES = [c.split()[0] for c in _MADE.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


class _Read:
    """A text with its walk."""

    def __init__(self, w: Walker, doc_id: int | None, text: str | None):
        self.id, self.text = doc_id, text or ""
        self.codes = w.classes(self.text)
        self.states = w.states(self.codes)
        self.print = w.print(self.codes, self.states)
        self.keys = frozenset(w.bands(self.print, BANDS, BITS).tolist())

    def with_next(self, w: Walker, after: _Read) -> tuple:
        n = len(self.text)
        cut = n - n // PART
        tail = after.text[: n // PART]
        edited = self.text[:cut] + tail
        rest = w.classes(tail)
        states = np.concatenate((self.states[:cut], w.states(rest, int(self.states[cut]))))
        fresh = w.print(self.codes[:cut] + rest, states)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        shared = (len(self.keys.intersection(b)) for b in (w.bands(fresh, BANDS, BITS).tolist(), after.keys))
        return (self.id, n, sha, str(self.print), str(fresh), w.likeness(self.print, fresh), w.likeness(self.print, after.print), *shared)


def _neighbours(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows in order to what is said of each with the next; the first and last row of a task go on with their texts."""
    w, last, context = walker(seed), None, TaskContext.get()
    task = context.partitionId() if context else 0
    names = ["kind", "task", "text", *_NAMES]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.string(), *_TYPES], strict=True)], names)

    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            now = _Read(w, doc_id, text)
            out.append((1, task, text or "", doc_id, *[None] * (len(_NAMES) - 1)) if last is None else (0, task, None, *last.with_next(w, now)))
            last = now
        yield batch_of(out)
    if last is not None:
        yield batch_of([(2, task, last.text, last.id, *[None] * (len(_NAMES) - 1))])


def _borders(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    w = walker(seed)
    for batch in batches:
        rows = [_Read(w, i, a).with_next(w, _Read(w, None, b)) for i, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def compare_edited(docs: DataFrame, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """Each document of docs(doc_id, text) with its edited text and with the next document by ascending doc_id.

    The edited text has its last quarter replaced by as much of the next document's beginning; the last document
    is followed by the first, a single one by itself. bands_edited and bands_next say how many bands a pair shares
    (none: banding would not have made it a candidate); near_* verify it. Null texts are empty; null ids come first; ties go by text; an
    empty table gives an empty one; very long texts are read whole; other columns of docs, whatever their names, are
    not read. A code point above 255 is walked by an eighth of its hash: texts in such scripts look a little more alike.
    Texts are shuffled once, into ranges of ids; neighbours in different ranges meet by the number of the range,
    so only two texts a range move again.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = stored(ranged.mapInArrow(partial(_neighbours, seed=seed), f"kind int, task int, text string, {_MADE}"))
    tasks = sorted(r["task"] for r in made.where("kind = 1").select("task").collect())  # as many as ranges
    follows = spark.createDataFrame([(t, tasks[(i + 1) % len(tasks)]) for i, t in enumerate(tasks)], "task int, next_task int")
    first = made.where("kind = 1").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"))
    borders = made.where("kind = 2").select("task", "doc_id", "text").join(F.broadcast(follows), "task").join(first, "next_task").select("doc_id", "text", "next_text")
    return made.where("kind = 0").select(*_NAMES).unionByName(borders.mapInArrow(partial(_borders, seed=seed), _MADE))


def _print(batches: Iterator[pa.RecordBatch], seed: int, bands: int, bits: int) -> Iterator[pa.RecordBatch]:
    w = walker(seed)
    for batch in batches:
        prints = [w.read(text) for text in batch.column(1).to_pylist()]
        keys = [w.bands(p, bands, bits).tolist() for p in prints]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(str, prints), pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fingerprint", "bands"])


def fingerprints(docs: DataFrame, seed: int = SEED, bands: int = BANDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint, bands of docs(doc_id, text). Equal texts have equal fingerprints; null texts are empty."""
    ready_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_print, seed=seed, bands=bands, bits=bits), "doc_id long, fingerprint string, bands array<long>")


def likeness_to(w: Walker, one: Print, steps: np.ndarray, octaves: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Walker.likeness of a fingerprint with many others at once; bits (fingerprints x octaves x OCTAVE) is padded."""
    total = np.maximum(one.steps, steps)
    agree = np.zeros(len(steps))
    for k in range(min(len(one.bits), bits.shape[1])):
        low, high = (OCTAVE << (k - 1) if k else 0), (OCTAVE << k if k else OCTAVE)
        inside = np.searchsorted(w.sample(k)[0], total)
        same = np.cumsum(bits[:, k] == one.bits[k], axis=1)[np.arange(len(steps)), np.maximum(inside, 1) - 1]
        agree += np.where((octaves > k) & (inside > 0), (np.minimum(high, total) - low) * (2 * same / np.maximum(inside, 1) - 1), 0.0)
    return np.clip(agree / np.maximum(total, 1), 0, 1)


def _verify(batches: Iterator[pa.RecordBatch], seed: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, fingerprint, b, fingerprint) to the links (a, b)."""
    w = walker(seed)
    for batch in batches:
        a, first, b, second = (batch.column(i).to_pylist() for i in range(4))
        hit = [i for i in range(len(a)) if w.likeness(Print.parse(first[i]), Print.parse(second[i])) >= least]
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in hit], pa.int64()) for v in (a, b)], ["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch], seed: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, side, rep, fingerprint) sorted by block, the first three, to links between its sides that join
    what is not yet joined."""
    w = walker(seed)

    def links(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        told = [r for r in rows if r[0] == 1]
        prints = [Print.parse(r[2]) for r in told]
        octaves = np.array([len(p.bits) for p in prints], np.int64)
        bits = np.zeros((len(prints), octaves.max(initial=0), OCTAVE), np.uint8)
        for p, b in zip(prints, bits, strict=True):
            b[: len(p.bits)] = p.bits
        steps, root, a, b = np.array([p.steps for p in prints], np.int64), {}, [], []

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        for rep, text in (r[1:] for r in rows if r[0] == 0):
            for j in np.flatnonzero(likeness_to(w, Print.parse(text), steps, octaves, bits) >= least).tolist():
                if (p := find(rep)) != (q := find(told[j][1])):
                    root[p] = q
                    a.append(rep)
                    b.append(told[j][1])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    block, rows = None, []
    for batch in batches:
        for *at, side, rep, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if at != block:
                if rows:
                    yield links(rows)
                block, rows = at, []
            rows.append((side, rep, text))
    if rows:
        yield links(rows)


def _across(banded: DataFrame, hubs: DataFrame, groups: DataFrame, prints: DataFrame, seed: int, least: float, part: int) -> DataFrame:
    """Links of outliers, members of a band outside its least id's component, with all members of the band, in blocks."""
    own = groups.withColumnsRenamed({"id": "rep"})
    members = banded.join(hubs, "band").join(own, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = members.join(groups.select(F.col("id").alias("hub"), F.col("component").alias("core")), "hub", "left")
    members = stored(members.select("band", "rep", (F.col("component") != F.coalesce("core", "hub")).alias("out")))
    parts = lambda n: F.ceil(n / part)
    mixed = stored(members.groupBy("band").agg(parts(F.count_if("out")).alias("p_out"), parts(F.count(F.lit(1))).alias("p_all")).where("p_out > 0"))
    rows = members.join(mixed, "band").withColumns({"i": F.pmod(F.xxhash64("rep"), F.col("p_out")), "j": F.pmod(F.xxhash64("rep"), F.col("p_all"))})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = rows.where("out").select("band", "i", every("p_all").alias("j"), F.lit(0).alias("side"), "rep")
    told = rows.select("band", every("p_out").alias("i"), "j", F.lit(1).alias("side"), "rep")
    full = stored(asks.unionByName(told)).join(prints, "rep").select("band", "i", "j", "side", "rep", "fingerprint")
    return full.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(partial(_alike, seed=seed, least=least), "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8, miss: float = 1e-3, seed: int = SEED, part: int = 1024) -> DataFrame:
    """doc_id, component_id, kept: documents linked by likeness of least or more with another of a band they share.

    Equal fingerprints are one class, whose least id stands for it. Documents without characters and null ids link
    with nothing; null texts are empty, very long ones are read whole; rows that share an id count as one document;
    an empty table gives an empty one; other columns are not read. Each member of a band is compared with its least id;
    members that are not in that one's component are then compared with all members, on fingerprints, in blocks of
    ``part`` by ``part``. So a group of near copies is compared once a member, no task gathers a band, and nothing
    rests on which member is the least. bits and bands follow from the number of documents (plan_bands).
    """
    bits, bands = plan_bands(docs.count(), least, miss)
    made = stored(fingerprints(docs, seed, bands, bits))
    real = made.where(F.col("doc_id").isNotNull() & (F.size("bands") > 0))
    classes = stored(real.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    same = real.select("fingerprint", "doc_id").join(classes.where("copies > 1").select("fingerprint", "rep"), "fingerprint").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    banded, prints = classes.select("rep", F.explode("bands").alias("band")), classes.select("rep", "fingerprint")
    hubs = stored(banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub"))
    met = stored(banded.join(hubs, "band").where("rep > hub").select("hub", "rep").distinct())
    left = met.join(prints.withColumnsRenamed({"rep": "hub", "fingerprint": "first"}), "hub").join(prints, "rep")
    links = stored(left.select("hub", "first", "rep", "fingerprint").mapInArrow(partial(_verify, seed=seed, least=least), "a long, b long").unionByName(same))
    found = _across(banded, hubs, stored(components(links)), prints, seed, least, part)
    groups = stored(components(links.unionByName(stored(found))))
    out = made.select("doc_id").join(groups, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
