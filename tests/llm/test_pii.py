import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm.pii import KINDS, SKIP, _examples, base_spans, edges, find, luhn, marginals, mask, train

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(x):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(*m.span(), 0) for m in EMAIL.finditer(x)]
    out += [(*m.span(), 1) for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in CARD.finditer(x) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(*m.span(), 3) for m in PHONE.finditer(x) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def line(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def test_base_spans_of_random_texts():
    r = random.Random(3)
    bits = [*"a1.@+- ()9Z%_\n0", "255.", "1.2.3.4", "4111 1111 1111 1111", "@x.y", "+1 555", "00000255"]
    for _ in range(5000):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert base_spans(x) == brute(x)


@pytest.fixture(scope="module")
def field(spark):
    return train(spark.createDataFrame([("call +1 555 123 4567 or x@y.com and 4111 1111 1111 1111, 10.0.0.1, id 12345678",)] * 20, "text string"))


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in find(docs, train(docs)).collect():
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(line(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(k == i for *_, k in want) for i in range(4)]
        assert set(line(want).split(",")) <= set(r["spans"].split(","))


def test_repeats_share_labels(field):
    x = "Call +1 (555) 123-4567 today. " + "Some words between. " * 40 + "Later: 555 123 4567 is busy; order 98765432 shipped; joe.doe@ex.com aka joe.doe (at) ex (dot) com"
    base, spans = field.spans(x)
    assert [x[s:e] for s, e, _ in base] == ["+1 (555) 123-4567", "joe.doe@ex.com"]
    assert [(x[s:e], KINDS[k]) for s, e, k in spans if (s, e, k) not in base] == [("555 123 4567", "phone"), ("joe.doe (at) ex (dot) com", "email")]


def test_skip_edges_are_linear():
    assert len(edges(["5551234567"] * 1000)) == 999
    assert edges(["15551234567", "9", "5551234567"]) == [(0, 2)]


def test_masking(spark, field):
    df = spark.createDataFrame([(1, "to a@b.co and +1 555 123 4567."), (2, None), (3, "nothing")], "doc_id long, text string")
    assert [r["text"] for r in mask(df, field).orderBy("doc_id").collect()] == ["to <EMAIL> and <PHONE>.", None, "nothing"]


def test_odd_rows(odd, empty, field):
    got = find(odd, field).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"]: r["spans"] for r in got}[1] == ""
    assert "email" in {r["doc_id"]: r["spans"] for r in got}[12]
    assert find(empty, field).count() == 0
    assert mask(odd, field).count() == odd.count()
    assert train(empty).spans("a@b.co")[0] == [(0, 6, 0)]


def test_potentials_are_learned_from_all_texts(spark):
    text = "call +1 555 123 4567 or x@y.com, card 4111 1111 1111 1111, host 10.0.0.1, id 12345678; again +1 555 123 4567 and 12345678"
    many = spark.createDataFrame([(text,)] * 300, "text string")
    got = train(many)
    again = train(many.repartition(5))
    assert (got.weights == again.weights).all() and (got.chain == again.chain).all() and got.skip == again.skip
    assert got.skip != SKIP and abs(got.chain).max() > 0
    # repeated numbers that never agree weaken the skip potential
    mixed = spark.createDataFrame([("+4111 1111 1111 111 1 then 4111 1111 1111 1111",)] * 300, "text string")
    assert train(mixed).skip < got.skip
    # a text of many nodes counts with all of them
    long = "id 12345678, " * 500 + "mail a@b.co"
    counts = Counter()
    for batch in _examples(iter([pa.RecordBatch.from_arrays([pa.array([long])], ["text"])])):
        counts.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    assert sum(counts.values()) == 501


def test_marginals_equal_brute_force():
    """On a chain and on one loop, against sums over all labellings (exact on the chain)."""
    rng = np.random.default_rng(0)
    node, chain = rng.normal(size=(4, 5)), rng.normal(size=(5, 5)) * 0.3

    def brute_marginals(skips, fixed):
        total = np.zeros((4, 5))
        for y in itertools.product(range(5), repeat=4):
            if all(f in (-1, v) for f, v in zip(fixed, y, strict=True)):
                score = sum(node[i, v] for i, v in enumerate(y) if fixed[i] < 0) + sum(chain[y[i], y[i + 1]] for i in range(3)) + sum(1.5 * (y[i] == y[j]) for i, j in skips)
                for i, v in enumerate(y):
                    total[i, v] += np.exp(score)
        return total / total.sum(axis=1, keepdims=True)

    free = np.array([-1, -1, -1, -1])
    assert np.allclose(marginals(node, free, chain, [], rounds=40), brute_marginals([], free), atol=1e-6)
    fixed = np.array([2, -1, -1, -1])
    assert np.abs(marginals(node, fixed, chain, [(0, 3)], 1.5, 60) - brute_marginals([(0, 3)], fixed)).max() < 0.05
