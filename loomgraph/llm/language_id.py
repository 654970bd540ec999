"""Language identification in two steps: the family first, then one-versus-one linear support vector machines.

Texts become relative frequencies of hashed character n-grams of their letters. A one-versus-rest linear SVM picks
the family; inside the family one SVM for each pair of languages votes. All models are linear in the frequencies,
so a text is scored by averaging the weights of its n-grams: one narrow pass, whole texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import kept, ready_workers, trim

#: Families by language code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "am"),
    "indic": ("hi", "bn", "mr", "ur", "ne", "pa"),
    "sinitic": ("zh", "yue"),
}
BITS = 13
#: Training texts: at most this many in all, spread evenly over the languages, 20 of each at least.
SAMPLE = 2000
#: Most languages.
MAX_LANGUAGES = 200
_LETTER: list[np.ndarray] = []


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def grams(text: str) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams of the text's letters in lower case; other runs are one space."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[0][a]
    if not letter.any():
        return np.zeros(0, np.int64)
    a = np.where(letter, a, np.uint32(32))
    keep = np.r_[True, letter[1:] | letter[:-1]]
    a = np.concatenate(([32], a[keep], [32])).astype(np.uint32)
    one = a * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ np.uint32(0x1B873593)) * np.uint32(0xC2B2AE35) + one[2:]
    return np.concatenate([(h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS) for h in (one[1:-1], two, three)]).astype(np.int64)


def _frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(grams(text), minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at, count[at] / max(1, count.sum())


def train_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and balanced classes, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    size = float(np.einsum("ij,ij->i", x, x).max(initial=1e-12)) + 1
    rate = 1 / (2 * size + l2)
    for k in range(rounds):
        m = share * np.maximum(0, 1 - y * (x @ vw.astype(x.dtype) + vb)) * y
        nw, nb = vw - rate * (l2 * vw - 2 * (m.astype(x.dtype) @ x)), vb + rate * 2 * m.sum()
        q = k / (k + 3)
        vw, vb, w, b = nw + q * (nw - w), nb + q * (nb - b), nw, nb
    return w, b


@dataclass
class Model:
    """Columns of weights: one a family (if there are several), then one a pair of languages of a family."""

    families: list[str]
    langs: dict[str, list[str]]
    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def margins(self, text: str) -> np.ndarray | None:
        g = grams(text)
        if not len(g) or not self.families:
            return None
        return self.weights[g].mean(axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        m = self.margins(text) if text else None
        if m is None:
            return "und", 0.0
        sure = lambda v: float(1 / (1 + np.exp(-4 * v)))
        score, at = 1.0, 0
        if len(self.families) > 1:
            own = m[: len(self.families)]
            at, score = int(own.argmax()), sure(own.max())
        langs = self.langs[self.families[at]]
        votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        first = len(self.families) if len(self.families) > 1 else 0
        for k, (a, b) in enumerate(self.pairs):
            if a in votes:
                v = m[first + k]
                votes[a if v >= 0 else b] += 1
                sums[a] += v
                sums[b] -= v
        best = max(langs, key=lambda x: (votes[x], sums[x], x))
        if len(langs) > 1:
            score *= sure(sums[best] / (len(langs) - 1))
        return best, score


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model from (language, bucket numbers, frequencies) of some texts."""
    langs = sorted({r[0] for r in rows})
    families = sorted({family_of(x) for x in langs})
    by = {f: [x for x in langs if family_of(x) == f] for f in families}
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, (_, at, value) in enumerate(rows):
        x[i, at] = value
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-6)).astype(np.float32)
    x *= 3 * scale
    own = np.array([r[0] for r in rows], object)
    fam = np.array([family_of(r[0]) for r in rows], object)
    weights, bias, pairs = [], [], []
    if len(families) > 1:
        for f in families:
            w, b = train_svm(x, np.where(fam == f, 1.0, -1.0))
            weights.append(w)
            bias.append(b)
    for f in families:
        for a, b in combinations(by[f], 2):
            part = (own == a) | (own == b)
            w, c = train_svm(x[part], np.where(own[part] == a, 1.0, -1.0))
            weights.append(w)
            bias.append(c)
            pairs.append((a, b))
    w = (np.stack(weights, axis=1) if weights else np.zeros((1 << BITS, 0))) * (3 * scale)[:, None]
    return Model(families, by, w.astype(np.float32), np.array(bias), pairs)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept()
    for batch in batches:
        langs, hashes, at, value = [], [], [], []
        for lang, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, v = _frequencies(text)
            if len(a):
                langs.append(lang)
                hashes.append(h)
                at.append(a.astype(np.int32))
                value.append(v.astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "h", "at", "value"])


def sampled(rows: DataFrame, quotas: dict[str, tuple[int, int]]) -> DataFrame:
    """(lang, h, text): for each language of rows(lang, h, text), h a hash of the text, the texts of least hash.

    quotas: for each language how many distinct texts to take (all if it has fewer) and about how many it has. Hashes
    are ranked, texts stay where they are: a threshold set from the number of texts leaves a rank about four times
    the quota of hashes to look at. Copies of a text count once.
    """
    spark, top = rows.sparkSession, float((1 << 63) - 1)
    limits = spark.createDataFrame([(k, q, min(1.0, 4.0 * q / max(1, n)) if n > 8 * q else 1.0) for k, (q, n) in quotas.items()], "lang string, quota int, upto double")
    few = rows.select("lang", "h").join(F.broadcast(limits), "lang").where(F.col("h") <= F.col("upto") * top).distinct()
    ranked = few.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where("place <= quota")
    chosen = spark.createDataFrame(ranked.select("lang", "h").collect(), "lang string, h long")  # the quotas' sum at most
    return rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on docs(text, lang): sample / languages distinct texts of each language (20 at least), or all it has.

    A language is learned if one of its texts has a letter. Null languages and null texts teach nothing; an empty
    table gives a model without languages. What is drawn rests on the texts alone, not on the order of rows.
    """
    ready_workers(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64("text", F.lit(5)), 1).alias("h"), "text")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model([], {}, np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    drawn = sampled(rows, {r["lang"]: (max(20, sample // len(counts)), r["n"]) for r in counts})
    got = drawn.mapInArrow(_features, "lang string, h long, at array<int>, value array<float>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    lists = [got.column(c).combine_chunks() for c in ("at", "value")]
    cuts = lists[0].offsets.to_numpy()[1:-1]
    at, value = (np.split(c.values.to_numpy(), cuts) for c in lists)
    model = fit(list(zip(got.column("lang").to_pylist(), at, value, strict=True)))
    del got, lists, at, value
    trim()
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    kept()
    for batch in batches:
        out = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [*batch.schema.names, *names])


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with two more columns of these names: lang_pred (a learned language, ``und`` for texts that are null or have no letter) and lang_score.

    The text is the only input. Rows are independent: repeated rows get equal results, an empty table gives an
    empty one, and a model without languages says ``und``. Columns of docs named like a result are replaced. All
    other columns pass through untouched, so texts are read once and never shuffled.
    """
    ready_workers(docs.sparkSession)
    others = [c for c in docs.columns if c not in (*names, "text")]
    df = docs.select(*(F.col(f"`{c}`") for c in others), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{names[0]}` string", f"`{names[1]}` double"])
    return df.mapInArrow(partial(_predict, model=model, names=names), schema)
