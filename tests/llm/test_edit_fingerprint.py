import hashlib
import random

import numpy as np
import pytest

from loomgraph.llm.edit_fingerprint import BANDS, BITS, OCTAVE, Print, compare_edited, fingerprints, likeness_to, near_duplicates, plan_bands, walker


def brute(rows):
    w = walker()

    def shared(p, q):
        return len(set(w.bands(p, BANDS, BITS).tolist()) & set(w.bands(q, BANDS, BITS).tolist()))

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        a, b, c = w.read(t), w.read(e), w.read(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(a), str(b), round(w.likeness(a, b), 12), round(w.likeness(a, c), 12), shared(a, b), shared(a, c)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 12), round(r["near_next"], 12), r["bands_edited"], r["bands_next"]) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(compare_edited(docs, partitions=3)) == brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(odd, empty):
    assert found(compare_edited(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert compare_edited(empty).count() == 0
    assert fingerprints(odd).count() == odd.count()
    one = odd.where("doc_id = 5")
    assert found(compare_edited(one)) == brute([(5, one.first()["text"])])


def test_likeness_falls_with_edits():
    w = walker()
    text = " ".join(f"word{i * i % 1009}" for i in range(600))
    near = w.likeness(w.read(text), w.read(text[:1000] + "X" + text[1000:]))
    far = w.likeness(w.read(text), w.read(text[::-1]))
    assert w.likeness(w.read(text), w.read(text)) == 1
    assert near > 0.9 > 0.3 > far
    assert w.likeness(w.read(""), w.read("")) == 1
    p = w.read(text)
    assert str(Print.parse(str(p))) == str(p)


def test_near_duplicates(spark):
    base = " ".join(f"word{i * 37 % 1009}" for i in range(400))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base[:900] + "?" + base[900:]), (4, base[::-1]), (5, None), (None, base)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, None: None}


def test_bands_ask_more_of_more_texts():
    """Unrelated texts of any length seldom share a band; alike ones nearly always do."""
    rng = random.Random(9)
    w = walker()
    bits, bands = plan_bands(10_000, 0.8, 1e-3)
    assert plan_bands(10**9, 0.8, 1e-3)[0] > bits and plan_bands(0, 0.8, 1e-3)[1] >= 1 and plan_bands(100, 1.0, 1e-3)[1] >= 1
    with pytest.raises(ValueError, match="bands a level"):
        plan_bands(10**9, 0.2, 1e-3)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.choice((90, 260, 330, 650, 1300)) + rng.randrange(9))) for _ in range(400)]
    prints = [w.read(t) for t in texts]
    keys = [set(w.bands(p, bands, bits).tolist()) for p in prints]
    met = sum(not keys[i].isdisjoint(keys[j]) for i in range(400) for j in range(i))
    assert met <= 0.02 * 400 * 399 / 2
    alike = found = 0
    for t, p, k in zip(texts, prints, keys, strict=True):
        q = w.read(edited(rng, t, 1))
        if w.likeness(p, q) >= 0.8:
            alike += 1
            found += not k.isdisjoint(w.bands(q, bands, bits).tolist())
    assert alike > 150 and found >= 0.99 * alike


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", "yz"]) + text[i + rng.randrange(2) :]
    return text


def test_near_duplicates_against_all_pairs(spark):
    """Every pair of fingerprints by plain likeness: what banding finds of its components, and none that isn't there."""
    rng = random.Random(6)
    base = [" ".join(f"{c}{rng.randrange(3000)}" for _ in range(120)) for c in "abcdef"]
    texts = [edited(rng, base[i % 6], rng.choice((0, 0, 1, 1, 2, 4))) for i in range(150)]
    w = walker()
    prints = [w.read(t) for t in texts]
    bits = np.zeros((len(prints), max(len(p.bits) for p in prints), OCTAVE), np.uint8)
    for p, b in zip(prints, bits, strict=True):
        b[: len(p.bits)] = p.bits
    steps, octaves = np.array([p.steps for p in prints]), np.array([len(p.bits) for p in prints])
    pairs = set()
    for i, p in enumerate(prints):
        plain = np.array([w.likeness(p, q) for q in prints])
        quick = likeness_to(w, p, steps, octaves, bits)
        assert np.allclose(plain, quick)
        pairs |= {(i, j) for j in np.flatnonzero(plain >= 0.8).tolist() if j != i}
    assert len(pairs) > 1000
    for part in (1024, 16):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), part=part).collect()}
        linked = sum(got[i] == got[j] for i, j in pairs)
        assert linked >= 0.99 * len(pairs)
        root = list(range(len(texts)))
        for i, j in sorted(pairs):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        assert all(root[i] == root[got[i]] for i in got)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and near_duplicates(empty).count() == 0
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[6] == by[5] == 5 and by[1] == 1 and by[2] == 2 and by[None] is None and by[10] == 9
