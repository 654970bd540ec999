import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm.bpe import Encoder, Transducer, Vocabulary, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return Vocabulary(f.read())


def encoder(v, words, decimal=False):
    return Encoder(v, Transducer.mapped(Transducer.compile({w.encode(): v.merge(w.encode()) for w in words}).pack()), decimal)


def same(v, e, texts):
    for t, ids, (n, a, b) in zip(texts, e.encode(texts), Encoder(v, e.transducer, True).digests(texts), strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        decoded = LIBRARY.decode(want, skip_special_tokens=False)
        assert v.decode(ids) == decoded
        assert (n, a, b) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_like_the_library_on_texts(spark, sf, vocabulary):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    words = {w for t in texts[::3] for w in vocabulary.split(t)}
    same(vocabulary, encoder(vocabulary, words), texts)


def test_like_the_library_on_random_signs(vocabulary):
    r = random.Random(1)
    bits = [" ", "a", "the", "'s", "'ll", "\n", "\x1c", "\x85", "\u200b", "\u3000", "é", "日", "1", "٣", "!!", "<|endoftext|>", "\t", "\r\n", "\x00", "😀", "ʰ", "\u0301", "²", "Ⅷ", "_", "\xa0", "\ufeff", "ɏ", "ɐ", "·", "½"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["a" * 5000, "ab" * 3000, " " * 3000, "", "é" * 999]
    same(vocabulary, encoder(vocabulary, [" the", "a"]), texts)


@given(st.text(max_size=40))
def test_round_trip(text):
    if not hasattr(test_round_trip, "e"):
        with open(PATH, encoding="utf-8") as f:
            v = Vocabulary(f.read())
        test_round_trip.e = encoder(v, [])
    e = test_round_trip.e
    assert e.vocabulary.decode(next(iter(e.encode([text])))) == text


def test_transducer_is_minimal_and_exact(vocabulary):
    words = {b"tap": [1, 2], b"taps": [3], b"top": [4], b"tops": [5], b"": [6]}
    t = Transducer.compile(words)
    assert len(t.first) - 1 == 5  # start, t, t[ao], p, s: suffixes are shared
    m = Transducer.mapped(t.pack())
    order = sorted(words)
    ranks = m.ranks([*order, b"ta", b"x", b"tapss"])
    assert ranks.tolist() == [0, 1, 2, 3, 4, -1, -1, -1]
    assert [m.out[m.at[r] : m.at[r + 1]].tolist() for r in range(5)] == [words[w] for w in order]
    assert Transducer.compile({}).ranks([b"a"]).tolist() == [-1]


def test_operator_like_the_library(spark, sf):
    """All three results, with a small automaton and a store that is emptied again and again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {}
    for r in docs.collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (ids, LIBRARY.decode(ids, skip_special_tokens=False))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in encode_decode(docs, PATH, words=500).collect():
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (*want[r["doc_id"]], len(r["ids"]))
    for r in encode_decode(docs, PATH, result="hashed").collect():
        assert (r["ids"], r["decoded_sha256"]) == (want[r["doc_id"]][0], sha(want[r["doc_id"]][1]))
    from loomgraph.llm.queries import QUERIES

    for r in QUERIES["op9_bpe"](spark, sf).collect():
        ids, text = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))


def test_a_store_that_is_emptied(vocabulary, monkeypatch):
    monkeypatch.setattr("loomgraph.llm.bpe.READY", 2000)
    texts = [f"word{i} and {i * 7} more of word{i % 5}" for i in range(200)]
    e = encoder(vocabulary, [" and"])
    for k in range(0, 200, 10):
        assert list(e.encode(texts[k : k + 10])) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[k : k + 10]]
        assert e.held < 2000 + 10 * 7 * 300


def test_odd_rows(odd, empty):
    got = encode_decode(odd, PATH, words=50)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {(r["doc_id"], len(r["ids"]) == r["n_tokens"]) for r in rows} == {(r["doc_id"], True) for r in rows}
    assert sorted((r["decoded"] for r in rows), key=repr) == sorted((r["text"] or "" for r in odd.collect()), key=repr)
    assert encode_decode(empty, PATH).count() == 0
