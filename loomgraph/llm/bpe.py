"""Byte-level BPE by a minimal acyclic transducer of frequent words, with exact merging of the rest.

The corpus is counted once (all of it); its most frequent words are merged, sorted and compiled into a
minimal acyclic automaton whose states are shared by equal suffixes. Arcs carry numbers that add up to the
rank of the word, and the rank gives its ids. The automaton is a set of flat arrays; a worker writes them to an
unnamed temporary file and maps it into memory. Words that are not in it are merged pair by pair, which gives
the same ids. Encoding is narrow: texts are not shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept, ready_workers, trim

#: The pattern that splits a text into words, fixed by the vocabulary. White space is Unicode's White_Space.
_WS = r"\t-\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|[" + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + r"]+"
#: The same for texts of ASCII and Latin letters, which need no Unicode tables, and what keeps a text from it.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
LATIN_WORDS = rf" ?[{LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+"
NOT_LATIN = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]"
#: Words in the automaton; bytes of words and ids of one generation kept ready by a worker (there are two); bytes of words counted before they are handed on.
LEXICON, READY, HELD = 1 << 17, 24 << 20, 24 << 20
#: About the bytes of an entry of a dictionary of words besides the word's letters.
ENTRY = 160
#: Longer words use a heap.
SHORT = 48
_NONE = 1 << 60  # no merge


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        chars = byte_chars()
        self.bytes_of: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        raw = lambda t: bytes(chars[c] for c in t)
        #: The id that a pair becomes. Ids of merges rise with their rank, so the least id is the merge to do.
        self.merges: dict[tuple[int, int], int] = {}
        last = -1
        for m in spec["model"]["merges"]:
            a, b = (raw(t) for t in (m if isinstance(m, list) else m.split(" ")))
            if ids[a + b] <= last:
                raise ValueError("the ids of merges are not in the order of their ranks")
            self.merges[ids[a], ids[b]] = last = ids[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self._any, self._latin, self._odd = regex.compile(WORDS).findall, re.compile(LATIN_WORDS).findall, re.compile(NOT_LATIN).search
        order = sorted(self.special, key=len, reverse=True)
        self.apart = regex.compile("|".join(regex.escape(t) for t in order)) if order else None

    def words(self, text: str) -> list[str]:
        return self._any(text) if self._odd(text) else self._latin(text)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the merge of lowest rank first, the leftmost of equals."""
        ids, get = [self.byte_id[b] for b in word], self.merges.get
        if len(ids) > SHORT:
            return self._merge_long(ids)
        made = [get(p, _NONE) for p in pairwise(ids)]
        while made and (best := min(made)) < _NONE:
            i = made.index(best)
            ids[i] = best
            del ids[i + 1], made[i]
            if i:
                made[i - 1] = get((ids[i - 1], best), _NONE)
            if i < len(made):
                made[i] = get((best, ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], bytearray(n)
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = new, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def split(self, text: str) -> list[str]:
        """The words of a text, special strings among them (no word is equal to one)."""
        if not any(t in text for t in self.special):
            return self.words(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words(text[at:])

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Transducer:
    """Minimal acyclic automaton over the bytes of sorted words, as flat arrays; its output is a list of ids.

    arcs of state s are rows first[s] to first[s + 1] of label, target and add; the sum of add along a word is
    its rank; ids of the word of rank r are out[at[r]:at[r + 1]].
    """

    FIELDS = (("first", np.int32), ("final", np.uint8), ("label", np.uint8), ("target", np.int32), ("add", np.int32), ("at", np.int32), ("out", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__ |= arrays
        # one sorted key per arc, so that a lookup of many words takes one search per byte position
        states = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
        self.key = states * 256 + self.label

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> Transducer:
        order = sorted(words)
        # states under construction: [final, [(label, state number), ...]]; equal finished states are shared
        shared: dict[tuple, int] = {}
        done: list[tuple] = []
        path: list[list] = [[False, []]]

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                final, arcs = path.pop()
                k = (final, tuple(arcs))
                if k not in shared:
                    shared[k] = len(done)
                    done.append(k)
                path[-1][1][-1] = (path[-1][1][-1][0], shared[k])

        last = b""
        for w in order:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            close(same)
            for b in w[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        done.append((path[0][0], tuple(path[0][1])))
        # children are finished before parents: words below each state, then the numbers on the arcs
        below: list[int] = []
        first, label, target, add = [0], [], [], []
        for final, arcs in done:
            n = int(final)
            for b, t in arcs:
                label.append(b)
                target.append(t)
                add.append(n)
                n += below[t]
            below.append(n)
            first.append(len(label))
        ids = [words[w] for w in order]
        return Transducer({
            "first": np.array(first, np.int32), "final": np.array([f for f, _ in done], np.uint8), "label": np.array(label, np.uint8), "target": np.array(target, np.int32),
            "add": np.array(add, np.int32), "at": np.cumsum([0, *map(len, ids)], dtype=np.int32), "out": np.array(list(chain.from_iterable(ids)), np.int32),
        })

    def pack(self) -> bytes:
        head = np.array([len(getattr(self, n)) for n, _ in self.FIELDS], np.int64).tobytes()
        return head + b"".join(getattr(self, n).tobytes() + b"\0" * (-getattr(self, n).nbytes % 8) for n, _ in self.FIELDS)

    @staticmethod
    def mapped(data: bytes) -> Transducer:
        """The automaton in memory-mapped form; the file has no name and goes with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            m = np.memmap(f, np.uint8, "r")
        n = len(Transducer.FIELDS)
        sizes, at, arrays = m[: 8 * n].view(np.int64), 8 * n, {}
        for size, (name, kind) in zip(sizes.tolist(), Transducer.FIELDS, strict=True):
            width = size * np.dtype(kind).itemsize
            arrays[name] = m[at : at + width].view(kind)
            at += width + -width % 8
        return Transducer(arrays)

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it is not in the automaton; all words advance byte by byte together."""
        rank = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.key):
            return rank
        width = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(width) - width
        flat = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        state, total = np.full(len(words), len(self.first) - 2, np.int64), np.zeros(len(words), np.int64)
        live, j = np.arange(len(words)), 0
        while len(live):
            ends = width[live] == j
            over = live[ends]
            rank[over] = np.where(self.final[state[over]] == 1, total[over], -1)
            live = live[~ends]
            if not len(live):
                break
            k = state[live] * 256 + flat[start[live] + j]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            hit = self.key[at] == k
            live, at = live[hit], at[hit]
            total[live] += self.add[at]
            state[live] = self.target[at]
            j += 1
        return rank


class Encoder:
    """Ids of texts: a store of words met, then the transducer, then exact merging.

    The store is bounded in bytes: a full generation becomes the old one, from which words that are met again are
    taken over, and the one before that goes.

    The store holds the ids of a word, or only their decimal form where digests are wanted.
    """

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer, decimal: bool = False):
        self.vocabulary, self.transducer, self.decimal = vocabulary, transducer, decimal
        self.ready: dict[str, tuple[int, ...] | str] = {}
        self.old: dict[str, tuple[int, ...] | str] = {}
        self.held = 0
        #: words whose ids decode to other bytes than their own
        self.changed: dict[str, bytes] = {}

    def words(self, texts: Sequence[str | None]) -> list[list[str]]:
        """The words of each text; all are in the store afterwards."""
        if self.held > READY:
            self.old, self.ready, self.held = self.ready, {}, 0
            self.changed = {w: b for w, b in self.changed.items() if w in self.old}
        out = [self.vocabulary.split(t) if t else [] for t in texts]
        self._learn(list(set(filterfalse(self.ready.__contains__, chain.from_iterable(out)))))
        return out

    def _learn(self, new: list[str]) -> None:
        v, t, bytes_of = self.vocabulary, self.transducer, self.vocabulary.bytes_of.__getitem__
        if self.old:
            again = list(filter(self.old.__contains__, new))
            self.ready.update(zip(again, map(self.old.__getitem__, again), strict=True))
            self.held += sum(map(len, again)) + (ENTRY + 30) * len(again)
            new = list(filterfalse(self.old.__contains__, new))
        raw = [w.encode() for w in new]
        rank = t.ranks(raw)
        first, last, out = t.at[rank].tolist(), t.at[rank + 1].tolist(), t.out
        for w, b, r, a, z in zip(new, raw, rank.tolist(), first, last, strict=True):
            ids = [v.special[w]] if w in v.special else out[a:z].tolist() if r >= 0 else v.merge(b)
            self.ready[w] = ",".join(map(str, ids)) if self.decimal else tuple(ids)
            self.held += ENTRY + len(b) + (8 if self.decimal else 36) * len(ids)
            if (back := b"".join(map(bytes_of, ids))) != b:
                self.changed[w] = back

    def encode(self, texts: Sequence[str | None]) -> Iterator[list[int]]:
        for words in self.words(texts):
            yield list(chain.from_iterable(map(self.ready.__getitem__, words)))

    def digests(self, texts: Sequence[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, sha256 of the ids in decimal joined by commas, sha256 of the decoded text.

        Decoding joins the bytes of all ids before it reads them as UTF-8. The ids of every word of the store were
        decoded when it was learned, so the words themselves stand for their bytes unless these differ.
        """
        for words in self.words(texts):
            ids = ",".join(map(self.ready.__getitem__, words))
            yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), self._decoded(words)

    def hashed(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """The ids, and sha256 of the decoded text."""
        for words in self.words(texts):
            yield np.fromiter(chain.from_iterable(map(self.ready.__getitem__, words)), np.int32), self._decoded(words)

    def _decoded(self, words: list[str]) -> str:
        if self.changed and not self.changed.keys().isdisjoint(words):
            back = b"".join(self.changed.get(w) or w.encode() for w in words).decode("utf-8", "replace").encode()
        else:
            back = "".join(words).encode()
        return hashlib.sha256(back).hexdigest()


def _count(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n), summed over as many texts as HELD allows; long words are left out, being merged where they occur."""
    v = kept(("vocabulary", hash(vocabulary.value)), lambda: Vocabulary(vocabulary.value))
    seen: Counter[str] = Counter()
    held = 0

    def handed() -> pa.RecordBatch:
        short = [(w, n) for w, n in seen.items() if len(w) <= SHORT]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            before = len(seen)
            words = v.split(text or "")
            seen.update(words)
            held += (len(seen) - before) * ENTRY + (len(text) if text and len(seen) > before else 0)
            if held > HELD:
                yield handed()
                seen, held = Counter(), 0
    yield handed()


def _encoder(vocabulary: Broadcast, automaton: Broadcast, decimal: bool) -> Encoder:
    """The worker's encoder for these broadcasts, kept between its tasks."""
    key = ("encoder", hash(vocabulary.value), hashlib.sha256(automaton.value).digest(), decimal)
    return kept(key, lambda: Encoder(Vocabulary(vocabulary.value), Transducer.mapped(automaton.value), decimal))


#: Result columns, by what is asked for.
MADE = {
    "text": {"n_tokens": "long", "ids": "array<int>", "decoded": "string"},
    "hashed": {"n_tokens": "long", "ids": "array<int>", "decoded_sha256": "string"},
    "digest": {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"},
}


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast, automaton: Broadcast, result: str) -> Iterator[pa.RecordBatch]:
    e = _encoder(vocabulary, automaton, result == "digest")
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        if result == "digest":
            made = list(e.digests(texts))
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))]
        else:
            made = list(e.hashed(texts))
            size = np.array([len(m[0]) for m in made], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int32)))
            columns = [pa.array(size), ids, pa.array([e.vocabulary.decode(m[0].tolist()) if result == "text" else m[1] for m in made], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *MADE[result]])


def lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON) -> bytes:
    """The packed automaton of the most frequent words of all texts: at most ``words`` words go to the driver."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(vocabulary)
    counts = docs.select("text").mapInArrow(partial(_count, vocabulary=given), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(words).select("word").toArrow().column(0).to_pylist()
    v = Vocabulary(vocabulary)
    packed = Transducer.compile({b: v.merge(b) for w in top if (b := w.encode())}).pack()
    del v, top
    trim()
    return packed


def encode_decode(docs: DataFrame, path: str, words: int = LEXICON, result: str = "text") -> DataFrame:
    """The columns of docs but text, with n_tokens and what ``result`` names.

    "text": ids (array of int) and decoded; "hashed": ids and decoded_sha256; "digest": ids_sha256 (of the ids in
    decimal, joined by commas) and decoded_sha256. path: a vocabulary file of the tokenizers library, read on the
    driver and broadcast (its size is fixed). Null texts are empty and have no ids; very long texts and words are
    encoded whole. Special strings in a text become their ids. Rows are independent: repeated rows get equal rows, an
    empty table gives an empty one. Columns of docs that are named like a result are left out.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    spark = docs.sparkSession
    ready_workers(spark)
    automaton = spark.sparkContext.broadcast(lexicon(docs, vocabulary, words))
    given = spark.sparkContext.broadcast(vocabulary)
    made = MADE[result]
    others = [f for f in docs.schema.fields if f.name != "text" and f.name not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{k} {t}" for k, t in made.items())])
    return docs.select(*(f"`{f.name}`" for f in others), "text").mapInArrow(partial(_encode, vocabulary=given, automaton=automaton, result=result), schema)
