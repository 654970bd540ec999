"""One query for each training-data operator: it runs the operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import id_bucket, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.edit_fingerprint import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.pii import find, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_bucket(F.col("doc_id"), 4) == 2)
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.suffix_tree import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_bucket(F.col("doc_id"), 7) == 2)
    return score(docs, docs.where(~F.col("held_out")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_bucket(F.col("doc_id"), 5) == 0)
    model = train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(id_bucket(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomgraph.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), result="digest")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_embedding, op3_fingerprint, op4_pii, op5_language, op6_mixing, op7_suffix_tree, op8_toxicity, op9_bpe, op10_url_filter, pipeline)}

#: SQL with the same rows, where SQL can say it. What learns a model, hashes like Spark or tokenizes can't be said;
#: tests/llm compares those with brute force, exact round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, n AS n_shingles, c AS component_id, c = doc_id AS kept FROM n JOIN m ON d = doc_id""",
    "op2_embedding": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS d, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept FROM v JOIN m ON d = vec_id LEFT JOIN k ON a = vec_id""",
}
