import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import suffix_tree
from loomgraph.llm.queries import QUERIES
from loomgraph.llm.suffix_tree import DEPTH, END, Lookup, Tree, arrays, build, learn, normal, score, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_base_scores_equal_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op7_suffix_tree"](spark, sf).collect()}
    words = {r["doc_id"]: WORD.findall((r["text"] or "").encode().lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    train = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, w in words.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, sum(x in c for x in w) + 1, n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0


def test_tree_gives_distributions(spark):
    texts = spark.createDataFrame([("abracadabra abracadabra",)] * 30 + [("banana bandana",)] * 20, "text string")
    tree = Tree(*arrays(*build(learn(texts).where("kind = 1").select("key", "n"), 2, 0.5)))
    for before in (b"", b"abra", b"ban", b"zzzzz", b"a"):
        lead = (bytes([0xFE]) * DEPTH + before)[-DEPTH:]
        codes = np.array([int.from_bytes(lead + bytes([x]), "big") for x in range(256)], np.uint64)
        assert math.isclose((10.0 ** tree.score(codes)).sum(), 1.0, abs_tol=1e-6)


def plain_tree(texts, least, gain):
    """Smoothed distributions of all contexts and the states among them, in plain Python."""
    n = Counter()
    for t in texts:
        run = bytes([0xFE]) * DEPTH + normal(t) + bytes([END])
        for i in range(DEPTH, len(run)):
            for d in range(DEPTH + 1):
                n[run[i - d : i], run[i]] += 1
    seen = {}
    for (c, x), k in n.items():
        seen.setdefault(c, {})[x] = k
    kept = {c: v for c, v in seen.items() if sum(v.values()) >= least}

    def p(c, x):
        if c is None:
            return 1 / 256
        low = p(c[1:] if c else None, x)
        v = kept[c]
        return (v.get(x, 0) + len(v) * low) / (sum(v.values()) + len(v))

    worth = {c for c, v in kept.items() if not c or sum(k * math.log(p(c, x) / p(c[1:], x)) for x, k in v.items()) >= gain}
    states = {c[i:] for c in worth for i in range(len(c) + 1)}

    def of(text):
        run, total = bytes([0xFE]) * DEPTH + normal(text) + bytes([END]), 0.0
        for i in range(DEPTH, len(run)):
            longest = next(run[i - d : i] for d in range(DEPTH, -1, -1) if run[i - d : i] in states)
            total += math.log10(p(longest, run[i]))
        return total

    return states, of


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_scores_equal_a_plain_tree(spark, broadcast):
    """Whether the tree is broadcast or joined, with words looked up in the task and by the join."""
    training = ["the cat sat on the hat and the dog sat on the cat", "a dog and a cat", None, "ab ab ab ab abc", "Dog"] * 9
    docs = ["the cat sat on the hat", "xqzj the pfft dog", None, "dog", "unseen \u00e9t\u00e9", "", "ABC abd", "the the the dog dog"]
    states, of = plain_tree(training, 3, 2.0)
    assert 50 < len(states) < 2000 and max(map(len, states)) == DEPTH
    table = lambda t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in score(table(docs), table(training), 3, 2.0, broadcast).collect()}
    for i, t in enumerate(docs):
        assert math.isclose(got[i]["score"], of(t), rel_tol=1e-5)
    counts = learn(table(training)).where("kind = 1").select("key", "n")
    assert build(counts, 3, 2.0)[0].count() == len(states)


def test_more_training_keeps_more_states(spark):
    """A context stays once it was seen LEAST times, whatever else the corpus holds."""
    rare = ["zebra quartz"] * 40
    counts = [learn(spark.createDataFrame([(t,) for t in rare + ["the cat sat on the hat"] * n], "text string")).where("kind = 1").select("key", "n") for n in (10, 4000)]
    few, many = ({r["key"] for r in build(c)[0].collect()} for c in counts)
    key = lambda c: int.from_bytes(c, "big") | (len(c) + 1) << 49
    assert {key(c) for c in (b"z", b"uart", b"artz")} & few == {key(c) for c in (b"z", b"uart", b"artz")} & many != set()
    assert len(many) > len(few)


@pytest.mark.parametrize("frequent", [0, 3])
def test_scores_do_not_rest_on_how_many_words_are_broadcast(spark, monkeypatch, frequent):
    docs = spark.createDataFrame([(1, "the cat sat on the hat"), (2, "xqzj the pfft dog"), (3, None), (4, "dog"), (5, "unseen")], "doc_id long, text string")
    training = spark.createDataFrame([("the cat sat on the hat and the dog sat on the cat",), ("dog",)] * 20, "text string")
    want = {r["doc_id"]: r for r in score(docs, training).collect()}
    monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
    got = {r["doc_id"]: r for r in score(docs, training).collect()}
    for i, r in want.items():
        assert got[i]["n_known"] == r["n_known"]
        assert math.isclose(got[i]["base_score"], r["base_score"], rel_tol=1e-9)
        assert math.isclose(got[i]["score"], r["score"], rel_tol=1e-9)


def test_odd_rows(odd, empty):
    got = score(odd, odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert "own kept" in {r["kept"] for r in rows}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert score(empty, odd).count() == 0
    assert len(score(odd, empty).collect()) == len(rows)


def test_windows_and_lookup():
    code, cut = windows([b"ab", b"", b"c"])
    assert cut.tolist() == [3, 4, 6]
    assert [int(c) & 0xFF for c in code] == [ord("a"), ord("b"), END, END, ord("c"), END]
    assert normal(" A\tb\n\nC ") == b"a b c"
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000, dtype=np.uint64))
    t = Lookup(keys, np.arange(len(keys)))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert np.isnan(t.get(np.setdiff1d(np.arange(1000, dtype=np.uint64), keys))).all()
    assert (Tree(*(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))).score(code) == -np.log10(256.0)).all()
