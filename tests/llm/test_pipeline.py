import hashlib

from tokenizers import Tokenizer

import corpus_pipeline as cp
from test_minhash import brute


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = kept[-1][1]
    before, after = kept[0]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"] for r in after.collect()} == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    before, after = kept[1]
    rows = before.select("doc_id", "text").collect()
    want = brute([r[0] for r in rows], [r[1] for r in rows], 5)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in want.items() if c == i}
    before, after = kept[2]
    assert before.count() == after.count()
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    assert after.where("text rlike '[a-z0-9]@[a-z0-9]+[.]com'").count() == 0
    before, after = kept[3]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    before, after = kept[4]
    library = Tokenizer.from_file(cp.public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert before.count() == after.count()
    for r in after.collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, odd, empty):
    """Each stage on nulls, empty and very long texts, repeated rows, null ids and clashing names, and on an empty table."""
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns, name
        assert stage(spark, empty, "").count() == 0, name
    assert cp.language(spark, odd, "").select("kept", "lang_pred").distinct().collect() == [("own kept", "own lang_pred")]
    assert ids(cp.language(spark, odd, "")) == sorted([4, 5, 6, 7, 8, 8, None, 9, 10, 11, 12], key=repr)
    assert {r["lang"] for r in cp.language(spark, odd, "").collect()} == {"en"}
    assert ids(cp.near_dedup(spark, odd, "")) == sorted([1, 2, 3, 4, 5, 8, 8, None, 9, 11, 12, 13], key=repr)
    clean = {r["doc_id"]: r for r in cp.personal_data(spark, odd, "").collect()}
    assert clean[12]["text"].endswith("mail <EMAIL>") and clean[1]["text"] is None and clean[2]["text"] == ""
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in clean.values())
    mixed = cp.mixing(spark, odd, "").collect()
    own = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] != 8}
    assert all(r["text"] == own[r["doc_id"]] for r in mixed if r["doc_id"] != 8)
    assert max(sum(m["doc_id"] == i for m in mixed) for i in own) <= 2
    made = cp.encoding(spark, odd, "")
    assert made.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert cp.encoding(spark, empty, "").count() == 0
    library = Tokenizer.from_file(cp.public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    rows = made.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_mixing_follows_the_plan(spark):
    """Words taken of each source, by whole copies, come near its target."""
    from pyspark.sql import functions as F

    from loomgraph.llm.mixing import mix, word_count

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = cp.mixing(spark, docs, "").groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("words"))
    plan = mix(docs).groupBy("source").agg(F.first("target").alias("target"))
    for r in out.join(plan, out["source"].eqNullSafe(plan["source"])).collect():
        assert abs(r["words"] - r["target"]) <= 0.15 * r["target"] + 2000


def test_no_sql():
    assert cp.ORACLE_SQL is None
