"""Toxicity: gradient-boosted trees over a few dense features of a text, with isotonic calibration.

Features: densities of a given and of a learned lexicon, lexicon words near second-person words, capitals,
punctuation, obfuscated words. The lexicon and the trees are learned from a bounded hash sample of the labelled
rows; scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept, ready_workers

#: Common insults of the four languages at hand.
LEXICON = frozenset("""
idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown fool jerk ugly
hate crap damn garbage filth vermin bastard imbecile cretin
dumm dummkopf trottel arschloch abschaum müll hässlich widerlich
imbécile crétin abruti connard salaud ordure débile dégoûtant
idiota imbécil estúpido tonto basura asqueroso cabrón
""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vosotros vuestro".split())
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
_WORD = re.compile(r"[^\W\d_]+").findall
#: A letter, then signs or digits that stand for letters, then a letter, in one word. Starts at the start of a run of
#: letters and never goes back, so it is linear in the text.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*_.\-]++[^\W\d_]++)++").findall
NEAR = 4
SAMPLE, LEARNED = 20_000, 200
#: One labelled row in HOLD only calibrates: neither the lexicon nor the trees learn from it.
HOLD = 4
FEATURES = 13


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    """The dense features of a text; all 0 for null and empty ones."""
    if not text:
        return [0.0] * FEATURES
    low = text.lower()
    words = _WORD(low)
    n = max(1, len(words))
    masked = _MASKED(low)
    plain = [w.translate(_PLAIN) for w in masked]
    hidden = sum(w in LEXICON or w in learned for w in plain)
    given = [i for i, w in enumerate(words) if w in LEXICON]
    odds = [learned[w] for w in words if w in learned]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if given else []
    close = sum((k := bisect_left(you, i - NEAR)) < len(you) and you[k] <= i + NEAR for i in given)
    size = len(text)
    letters = sum(map(len, words)) or 1
    capitals = size - len(text.translate(_NO_CAPITALS)) if size else 0
    marks = size - len(text.translate(_NO_MARKS))
    return [
        (len(given) + hidden) / n, math.log1p(len(given) + hidden), sum(odds) / n, math.log1p(len(odds)), max(odds, default=0.0), math.log1p(len(set(given and [words[i] for i in given]))),
        close / n, math.log1p(close), capitals / letters, marks / size, text.count("!") / size, len(masked) / n, math.log1p(hidden),
    ]


_NO_CAPITALS = dict.fromkeys([*range(ord("A"), ord("Z") + 1), *(ord(c) for c in "ÄÖÜÉÈÀÇÑÍÓÚÁ")])
_NO_MARKS = dict.fromkeys(map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿"))


class Boosted:
    """Trees of depth ``depth`` on histogram bins under logistic loss, then isotonic regression of the margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, out: np.ndarray | None = None, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 5.0, least: int = 10):
        self.depth, self.trees, self.base = depth, [], 0.0
        self.curve = (np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
        if not len(y):
            self.curve = (np.array([0.0]), np.array([0.0]))
            return
        # rows that the trees don't see, for calibration; one in HOLD unless the caller says which
        out = np.arange(len(y)) % HOLD == HOLD - 1 if out is None else out
        fit = ~out if 0 < y[~out].sum() < (~out).sum() else np.ones(len(y), bool)
        edges = [np.unique(np.quantile(x[fit, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[fit, f], "left") for f, e in enumerate(edges)], axis=1)
        p = np.clip(y[fit].mean(), 1e-3, 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        margin = np.full(fit.sum(), self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            g, h = y[fit] - q, q * (1 - q)
            node = np.zeros(len(g), np.int64)
            splits = []
            for level in range(depth):
                made = []
                for k in range(1 << level):
                    at = node == k
                    made.append(self._split(b[at], g[at], h[at], edges, l2, least))
                f = np.array([m[0] for m in made])
                c = np.array([m[1] for m in made])
                node = 2 * node + (b[np.arange(len(b)), f[node]] > c[node])
                splits.append((f, np.array([edges[i][j] if j < len(edges[i]) else np.inf for i, j in made])))
            leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
            margin += leaf[node]
            self.trees.append((splits, leaf))
        use = out if 0 < y[out].sum() < out.sum() else np.ones(len(y), bool)
        self.curve = isotonic(self.margin(x[use]), y[use].astype(float))

    @staticmethod
    def _split(b: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list, l2: float, least: int) -> tuple[int, int]:
        """Feature and bin of the best split; the last bin (all to one side) if none helps."""
        best, where = 1e-9, (0, len(edges[0]))
        if not len(b):
            return where
        whole = g.sum() ** 2 / (h.sum() + l2)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            n = len(e) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b[:, f], w, n))[:-1] for w in (g, h, None))
            gain = gs**2 / (hs + l2) + (g.sum() - gs) ** 2 / (h.sum() - hs + l2) - whole
            gain[(ns < least) | (len(b) - ns < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = float(gain[k]), (f, k)
        return where

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, c in splits:
                node = 2 * node + (x[rows, f[node]] > c[node])
            out += leaf[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margin(x), *self.curve), 0, 1) if len(x) else np.zeros(0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nondecreasing fit of y on x by pooling adjacent violators: knots and values, for interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    at = [v for p in pools for v in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    value = [p[0] / p[1] for p in pools for _ in range(2 if p[3] > p[2] else 1)]
    return np.array(at), np.array(value)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to partial document counts of words."""
    kept()
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[y].update(set(_WORD((text or "").lower())))
    words = list(seen[0].keys() | seen[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[y][w] for w in words], pa.int64()) for y in (0, 1))], ["word", "clean", "toxic"])


def learn_lexicon(rows: DataFrame, most: int = LEARNED, least: int = 8) -> dict[str, float]:
    """Words with the highest log odds of toxic documents among rows(toxic, text): at most ``most``."""
    n = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    words = rows.mapInArrow(_document_words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    top = words.select("word", odds.alias("odds")).where("odds > 1.5").orderBy(F.desc("odds"), "word").limit(most)
    return {r["word"]: float(r["odds"]) for r in top.collect()}


def _featured(batches: Iterator[pa.RecordBatch], learned: dict[str, float]) -> Iterator[pa.RecordBatch]:
    kept()
    for batch in batches:
        x = [features(t, learned) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["toxic", "held", "x"])


def _scored(batches: Iterator[pa.RecordBatch], learned: dict[str, float], model: Boosted) -> Iterator[pa.RecordBatch]:
    kept()
    for batch in batches:
        x = np.array([features(t, learned) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, FEATURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], [*batch.schema.names[:-1], "toxicity"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], Boosted]:
    """Lexicon and trees from docs(doc_id, text) and labels(doc_id, toxic): at most ``sample`` labelled rows.

    A quarter of them, by hash of the id, only calibrates. Labels other than 0 and 1, and null ids, are left out; an
    id labelled twice counts as toxic if any label is; rows that share an id all count; without labels every score is 0.
    """
    ready_workers(docs.sparkSession)
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = F.broadcast(ids.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample))  # bounded by sample
    held = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(HOLD)) == 0
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select("toxic", "text", held.alias("held"))
    learned = learn_lexicon(rows.where("not held").select("toxic", "text"))
    got = rows.mapInArrow(partial(_featured, learned=learned), "toxic int, held boolean, x array<double>").toArrow()
    y, held = (np.array(got.column(i).to_pylist(), float) for i in (0, 1))
    x = np.array(got.column(2).to_pylist(), float).reshape(-1, FEATURES)
    order = np.lexsort([*x.T, y, held])  # the order that rows arrive in doesn't matter
    return learned, Boosted(x[order], y[order], held[order] > 0)


def score(docs: DataFrame, model: tuple[dict[str, float], Boosted]) -> DataFrame:
    """docs(doc_id, ..., text) without the text, with toxicity: the calibrated probability of label 1.

    Null and empty texts have features of 0 and get the score of such. Whole texts are read, at a cost linear in their
    length. Rows are independent: repeated rows get equal scores; an empty table gives an empty one; a column of docs
    called toxicity is replaced, all others pass through.
    """
    ready_workers(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", "toxicity")]
    df = docs.select(*(F.col(f"`{c}`") for c in kept), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), "toxicity double"])
    return df.mapInArrow(partial(_scored, learned=model[0], model=model[1]), schema)
