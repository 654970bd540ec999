"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans (email, ip, card, phone); these always stay. The field looks at what the patterns
leave: runs of digits and written-out addresses. Each candidate and base span of a document is a node. Node
potentials are a softmax over shape features; neighbours in the text share chain potentials; tokens that repeat or
resemble each other (equal digits, or one number ending with the other) share skip potentials, however far apart.
All three are learned together from the base labels of all texts, by pseudo-likelihood: a node's label given its
features, the label before it and the label of a token like it, also with its tell-tale features masked. Loopy
belief propagation over each document makes equal tokens agree: a phone number that is written once with its
prefix is found where it is written without. A candidate whose marginal for a kind is high enough becomes a span.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept, ready_workers

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "other")
OTHER = len(KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]").search
#: Only the start of a run of digits can start a match; without going back, long runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
#: Runs that may be a number someone wrote differently, and addresses with words for the signs.
_RUN = re.compile(r"(?<![A-Za-z0-9])[(+]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?![A-Za-z0-9])").finditer
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]+)+").finditer
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Log-potential of agreement on a skip edge before anything is learned, least marginal of a span, rounds of message passing.
SKIP, SURE, ROUNDS = 4.0, 0.9, 12


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, leftmost and not overlapping within a kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            out.append((start, m.end(), 0))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    if _DIGIT(text):
        out += [(*m.span(), 1) for m in _IP(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
        for m in _CARD(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches that no base span touches."""
    found = []
    if _DIGIT(text):
        found += [m.span() for m in _RUN(text) if sum(c.isdigit() for c in m[0]) <= 19]
    if "at)" in text or "at]" in text:
        found += [m.span() for m in _SPELT(text)]
    out: list[tuple[int, int]] = []
    i, taken = 0, sorted((s, e) for s, e, _ in base)
    for s, e in sorted(found):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if not (i < len(taken) and taken[i][0] < e) and not (out and out[-1][1] > s):
            out.append((s, e))
    return out


FEATURES = 16


def features(text: str, s: int, e: int) -> np.ndarray:
    t = text[s:e]
    digits = _NOT_DIGIT.sub("", t)
    n, groups = len(digits), len(re.findall(r"[0-9]+", t))
    x = np.zeros(FEATURES)
    x[:10] = 1, "@" in t or "at)" in t or "at]" in t, any(c.isalpha() for c in t), t[0] == "+", "(" in t, t.count(".") == 3, "-" in t or " " in t, luhn(digits) if n else 0, groups == 1, groups == 4
    x[10:15] = n <= 8, 9 <= n <= 11, 12 <= n <= 15, n == 16, n > 16
    x[15] = s == 0 or text[s - 1].isspace() or text[s - 1] in "([\"'|:,;"
    return x


#: Features that give a kind away: masked in training too, so that the others get weight.
_TELLS = (1, 3, 5, 7)
#: Stands for no label where there is no node before, or none like it.
NONE = len(LABELS)
_BITS = 1 << np.arange(FEATURES)


def fit(codes: np.ndarray, n: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Node weights (features x labels), chain potentials (labels x labels) and the skip potential of agreement.

    codes, n: how often each example occurs (see _examples). Gradient descent on the pseudo-likelihood, every label
    with the same total weight; the chain is held near 0 and the skip potential near SKIP where little is known. A
    candidate that is like a base span is no example: patterns left it out, but it may well be of that kind.
    """
    k = len(LABELS)
    w, chain, skip = np.zeros((FEATURES, k)), np.zeros((k + 1, k)), SKIP
    y, before, like = codes >> FEATURES & 7, codes >> (FEATURES + 3) & 7, codes >> (FEATURES + 6) & 7
    keep = (y != OTHER) | (like == NONE) | (like == OTHER)
    codes, n, y, before, like = codes[keep], n[keep].astype(float), y[keep], before[keep], like[keep]
    if not len(y):
        return w, chain[:k], skip
    masks = [sum(1 << t for i, t in enumerate(_TELLS) if m >> i & 1) for m in range(1 << len(_TELLS))]
    shape = np.concatenate([codes & ~mask for mask in [0, *masks]]) & ((1 << FEATURES) - 1)
    weight = np.concatenate([n, *[n / len(masks)] * len(masks)])
    y, before, like = (np.tile(v, 1 + len(masks)) for v in (y, before, like))
    x, hot, last = (shape[:, None] & _BITS > 0).astype(float), np.eye(k)[y], np.eye(k + 1)[before]
    agree = np.eye(k + 1)[like][:, :k]
    share = weight / np.maximum(1e-9, np.bincount(y, weight, k))[y]
    share /= share.sum()
    for _ in range(rounds):
        z = x @ w + last @ chain + skip * agree
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - hot) * share[:, None]
        w -= x.T @ off + l2 * w
        chain -= last.T @ off + 0.1 * chain
        skip -= float((off * agree).sum()) + l2 * (skip - SKIP)
    return w, chain[:k], skip


def edges(keys: list[str]) -> list[tuple[int, int]]:
    """Skip edges: each token with the one before it that has the same key, and with the nearest earlier number
    that it ends or that ends it (at least 7 digits). Linear in the tokens, whatever repeats."""
    out, last, tails = [], {}, {}
    for i, k in enumerate(keys):
        if k in last:
            out.append((last[k], i))
        elif k.isdigit() and len(k) >= 7:
            j = tails.get(k[-7:])
            if j is not None and (keys[j].endswith(k) or k.endswith(keys[j])):
                out.append((j, i))
        last[k] = i
        if k.isdigit() and len(k) >= 7:
            tails[k[-7:]] = i
    return out


def marginals(node: np.ndarray, fixed: np.ndarray, chain: np.ndarray, skips: list[tuple[int, int]], skip: float = SKIP, rounds: int = ROUNDS) -> np.ndarray:
    """Label marginals by loopy sum-product over chain and skip edges; fixed holds labels that are given, or -1."""
    n, k = node.shape
    unary = node.copy()
    given = np.flatnonzero(fixed >= 0)
    unary[given] = -30.0
    unary[given, fixed[given]] = 0.0
    pair = [(i, i + 1, chain) for i in range(n - 1)] + [(i, j, np.eye(k) * skip) for i, j in skips]
    if not pair:
        m = np.exp(unary - unary.max(axis=1, keepdims=True))
        return m / m.sum(axis=1, keepdims=True)
    left, right = (np.array([p[c] for p in pair]) for c in (0, 1))
    weight = np.stack([p[2] for p in pair])
    m0, m1 = np.zeros((len(pair), k)), np.zeros((len(pair), k))  # to the right, to the left
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, right, m0)
        np.add.at(belief, left, m1)
        a = (belief[left] - m1)[:, :, None] + weight
        b = (belief[right] - m0)[:, None, :] + weight
        new0 = np.log(np.exp(a - a.max(axis=(1, 2), keepdims=True)).sum(axis=1) + 1e-300)
        new1 = np.log(np.exp(b - b.max(axis=(1, 2), keepdims=True)).sum(axis=2) + 1e-300)
        new0 -= new0.max(axis=1, keepdims=True)
        new1 -= new1.max(axis=1, keepdims=True)
        m0, m1 = 0.5 * m0 + 0.5 * new0, 0.5 * m1 + 0.5 * new1
    belief = unary.copy()
    np.add.at(belief, right, m0)
    np.add.at(belief, left, m1)
    m = np.exp(belief - belief.max(axis=1, keepdims=True))
    return m / m.sum(axis=1, keepdims=True)


def keys_of(text: str, nodes: list[tuple[int, int, int]]) -> list[str]:
    """What tells whether two tokens are alike: digits, or an address with its signs written out put back."""
    out = []
    for s, e, _ in nodes:
        low = re.sub(r"\s*[(\[]at[)\]]\s*", "@", re.sub(r"\s*[(\[]dot[)\]]\s*", ".", text[s:e].lower()))
        out.append(low if "@" in low else _NOT_DIGIT.sub("", low))
    return out


class Field:
    """Trained potentials: node weights (features x labels), chain (labels x labels) and agreement of like tokens."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: float = SKIP):
        self.weights, self.chain, self.skip = weights, chain, skip

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans, of a text; null and empty texts have none."""
        if not text:
            return [], []
        base = base_spans(text)
        more = candidates(text, base)
        if not more:
            return base, base
        nodes = sorted([(s, e, k) for s, e, k in base] + [(s, e, -1) for s, e in more])
        x = np.stack([features(text, s, e) for s, e, _ in nodes])
        m = marginals(x @ self.weights, np.array([k for *_, k in nodes]), self.chain, edges(keys_of(text, nodes)), self.skip)
        added = [(s, e, int(p.argmax())) for (s, e, k), p in zip(nodes, m, strict=True) if k < 0 and p.argmax() != OTHER and p.max() >= SURE]
        return base, sorted(base + added, key=lambda v: (v[0], v[2]))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to training nodes as (code, n): features, label, label before and label of an earlier token alike, packed."""
    kept()
    seen: Counter[int] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            base = base_spans(text or "")
            nodes = sorted([*base, *((s, e, OTHER) for s, e in candidates(text or "", base))])
            like = dict.fromkeys(range(len(nodes)), NONE) | {j: nodes[i][2] for i, j in edges(keys_of(text or "", nodes))}
            last = NONE
            for i, (s, e, k) in enumerate(nodes):
                seen[int(features(text, s, e) @ _BITS) | k << FEATURES | last << (FEATURES + 3) | like[i] << (FEATURES + 6)] += 1
                last = k
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])


def train(docs: DataFrame) -> Field:
    """Potentials from docs(text), from the base labels of all texts.

    Only counts of packed examples come to the driver: their number is bounded by what features and labels can be,
    not by the texts. Null and empty texts have no examples; an empty table gives a field that finds base spans only.
    """
    ready_workers(docs.sparkSession)
    likely = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    got = likely.mapInArrow(_examples, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    return Field(*fit(got.column("code").to_numpy().astype(np.int64), got.column("n").to_numpy()))


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _found(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    kept()
    for batch in batches:
        rows = [field.spans(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        counts = [pa.array([sum(k == i for *_, k in b) for b, _ in rows], pa.int64()) for i in range(len(KINDS))]
        sha = pa.array([hashlib.sha256(_line(b).encode()).hexdigest() for b, _ in rows], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, sha, pa.array([_line(a) for _, a in rows], pa.string())], [*batch.schema.names[:-1], *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """docs without the text, with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all of them).

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows are independent, texts are
    not shuffled, columns named like a result are replaced, an empty table gives an empty one.
    """
    ready_workers(docs.sparkSession)
    made = {**{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "spans": "string"}
    df = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in made), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), *(f"{k} {t}" for k, t in made.items())])
    return df.mapInArrow(partial(_found, field=field), schema)


def _masked(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    kept()
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text in batch.column(at).to_pylist():
            spans = field.spans(text)[1]
            if spans:
                parts, end = [], 0
                for s, e, k in spans:
                    if s >= end:
                        parts += [text[end:s], f"<{KINDS[k].upper()}>"]
                    end = max(end, e)
                text = "".join([*parts, text[end:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span of the text replaced by its kind, like <EMAIL>; overlapping spans by the first's.

    Null texts stay null and empty ones empty; rows are independent, other columns pass through, an empty table gives
    an empty one.
    """
    ready_workers(docs.sparkSession)
    return docs.mapInArrow(partial(_masked, field=field), docs.schema)
