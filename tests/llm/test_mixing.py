import re
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.llm.mixing import mix, mixed_documents, schedule, targets, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1]) == [200, 200, 50] or sum(targets([100, 100, 100], [5, 2, 1])) == 450
    t = targets([10, 1000, 1000], [5, 2, 1])
    assert t[0] == 20 and abs(sum(t) - 1.5 * 2010) < 1e-6 and all(a <= 2 * b + 1e-9 for a, b in zip(t, [10, 1000, 1000], strict=True))
    assert targets([], []) == []
    assert targets([0, 0], [5, 2]) == [0, 0]


def test_shares(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix(docs).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in texts.items()}
    by = Counter()
    for i, r in texts.items():
        by[r["source"]] += size[i]
    order = sorted(by)
    goal = dict(zip(order, targets([by[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == by[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(texts)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)


def test_reruns_and_partitions_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = sorted((r["doc_id"], r["taken"]) for r in mix(docs).collect())
    assert one == sorted((r["doc_id"], r["taken"]) for r in mix(docs.repartition(7)).collect())


def test_every_prefix_of_the_schedule_is_near_the_weights(spark):
    plan = spark.createDataFrame([(0, 0.0, 0.6), (1, 0.6, 0.9), (2, 0.9, 1.0)], "sx int, lo double, hi double")
    for n in (50, 5000):
        got = {r["sx"]: r["n"] for r in schedule(plan, n).groupBy("sx").agg(F.count("*").alias("n"), F.max("rank")).collect()}
        assert sum(got.values()) == n
        assert all(abs(got.get(i, 0) - n * w) <= 5 for i, w in enumerate((0.6, 0.3, 0.1)))
    ranks = sorted(r["rank"] for r in schedule(plan, 5000).where("sx = 1").collect())
    assert ranks == list(range(len(ranks)))


def test_odd_rows(odd, empty):
    rows = mix(odd, block_words=16).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["taken"] for r in rows if r["size"] == 0} == {0}
    taken, goal = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert mix(empty).count() == 0
    assert mixed_documents(empty).count() == 0
    got = mixed_documents(odd)
    assert got.columns == odd.columns
    assert got.where("doc_id in (1, 2, 3)").count() == 3


def test_documents_follow_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    goal = {r["source"]: (r["target"], r["source_size"]) for r in mix(docs).collect()}
    got = {r["source"]: r["n"] for r in mixed_documents(docs).groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
    biggest = docs.select(F.max(word_count(F.col("text")))).first()[0]
    assert all(abs(got.get(s, 0) - g) <= biggest for s, (g, _) in goal.items())
