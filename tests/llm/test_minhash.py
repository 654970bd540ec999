import re

import numpy as np
import pytest

from loomgraph.llm.components import components
from loomgraph.llm.minhash import near_duplicates
from loomgraph.llm.words import shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sets_of(texts, k):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(FOLD))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(ids, texts, k, percent=80):
    sets, root = sets_of(texts, k), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[i]), find(ids[j])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute([r[0] for r in rows], [r[1] for r in rows], k)
    got = {r["doc_id"]: r for r in near_duplicates(docs, k=k).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_a_group_of_near_copies_whose_centre_is_far(spark):
    """Texts with 0 to 30 edits of one text: not all are like the first, yet those that are like any are linked."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        t = list(base)
        for i in rng.choice(150, rng.integers(0, 8), replace=False):
            t[i] = f"z{rng.integers(1_000_000)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(range(len(texts)), texts, 4)
    for part in (1024, 16):  # one block, several blocks
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, k=4, part=part).collect()}
        assert got == want


def test_near_copies_whose_centres_are_all_larger(spark):
    """Documents with lower ids hold a passage and over 25% more; two near copies of the passage alone are still linked."""
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base + [f"x{c}_{i}" for i in range(50)]) for c in range(200)]
    texts += [" ".join(base), " ".join("z" if i in (40, 100) else w for i, w in enumerate(base))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(range(len(texts)), texts, 4)
    assert want[201][1] == 200
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, k=4).collect()}
    assert got == want


def test_odd_rows(odd, empty):
    got = near_duplicates(odd, k=4).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 2, 3, 4, 5, 5, 5, 8, 9, 9]
    assert by[None]["component_id"] is None
    assert near_duplicates(empty).count() == 0


def test_words_and_shingles():
    texts = ["A b\tC", "", None, "a B c", "a b c d", "x" * 2_000_000 + " y", " ".join(["q"] * 700_000)]
    got = dict(word_hashes(texts))
    assert np.array_equal(got[0], got[3])
    assert [len(got[i]) for i in range(7)] == [3, 0, 0, 3, 4, 2, 700_000]
    assert len(shingles(got[0], 4)) == 1 and len(shingles(got[4], 4)) == 1 and len(shingles(got[1], 4)) == 0
    assert shingles(got[0], 4)[0] != shingles(got[4], 4)[0]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(1, 1), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
