import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import language_id, toxicity
from loomgraph.llm.queries import QUERIES


def test_languages_of_held_out_texts(spark):
    got = QUERIES["op5_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right, n, least, most = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.99 and least >= 0 and most <= 1


def test_families_and_odd_rows(odd, empty):
    assert language_id.family_of("de") == language_id.family_of("en") != language_id.family_of("fr")
    assert language_id.family_of("xx") == "xx"
    model = language_id.train(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(odd, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 13)] == ["und"] * 4
    assert got[5][0] == "en"
    none = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    assert len(language_id.grams("12 345")) == 0


def test_a_language_of_few_texts_and_many_copies_is_learned(spark):
    english = ["the house is big and the dog is here", "we are going to the market now", "this is what they said to him", "she has been there with her friends", "all of you should come with us"]
    german = [f"das Haus Nummer {i} ist nicht so klein und der Hund {'x' * (i % 7)} schläft dort" for i in range(300)]
    french = [f"la maison {'y' * (i % 5)} est grande et le chien {i} dort dans la rue avec nous" for i in range(300)]
    rows = [(english[i % 5], "en") for i in range(20_000)] + [(t, "de") for t in german] + [(t, "fr") for t in french]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    drawn = language_id.sampled(docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)), {"en": (20, 5), "de": (20, 310), "fr": (20, 290)})
    assert {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()} == {"en": 5, "de": 20, "fr": 20}
    model = language_id.train(docs)
    assert sorted(sum(model.langs.values(), [])) == ["de", "en", "fr"]
    assert [model.predict(t)[0] for t in (english[0], german[7], french[9])] == ["en", "de", "fr"]
    again = language_id.train(docs.repartition(3))
    assert (again.weights == model.weights).all()


def test_predictions_equal_a_plain_scorer(spark, sf):
    """Margins summed gram by gram in plain Python over the fitted weights, families first, then votes of pairs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        letters = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        padded = " " + " ".join(letters.split()) + " "
        grams = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " " or 0 < i < len(padded) - 1]

        def bucket(g):
            h = 0
            mul = {2: (0x5BD1E995, 0x85EBCA6B), 3: (0x1B873593, 0xC2B2AE35)}
            for k, c in enumerate(g):
                one = ord(c) * 0x9E3779B1 & 0xFFFFFFFF
                h = one if k == 0 else ((h ^ mul[k + 1][0]) * mul[k + 1][1] + one) & 0xFFFFFFFF
            return (h * 0x27D4EB2F & 0xFFFFFFFF) >> (32 - language_id.BITS)

        if not letters.strip():
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        margin = [sum(float(model.weights[bucket(g)][c]) for g in grams) / len(grams) + model.bias[c] for c in range(model.weights.shape[1])]
        family = max(range(len(model.families)), key=lambda f: margin[f]) if len(model.families) > 1 else 0
        votes = dict.fromkeys(model.langs[model.families[family]], 0)
        for k, (a, b) in enumerate(model.pairs):
            if a in votes:
                votes[a if margin[(len(model.families) if len(model.families) > 1 else 0) + k] >= 0 else b] += 1
        assert votes[got[r["doc_id"]]["lang_pred"]] == max(votes.values())


def test_toxic_held_out_texts(spark):
    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = [(r["held_out"], r["toxic"], r["predicted"], r["score"]) for r in got.collect()]
    assert all((s >= 0.5) == (p == 1) and 0 <= s <= 1 for *_, p, s in rows)
    held = [(t, p) for h, t, p, _ in rows if h]
    assert sum(p for t, p in held if t) >= 0.8 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.01 * sum(1 - t for t, _ in held)


def test_rows_that_calibrate_teach_neither_words_nor_trees(spark):
    """A word that only held rows have is not learned; scores equal a plain walk down the trees and the curve."""
    from pyspark.sql import functions as F

    ids = spark.range(800).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(toxicity.HOLD)) == 0).alias("held"), (F.col("id") % 2).cast("int").alias("toxic"))
    bad = F.when(F.col("held"), F.lit("heldword")).otherwise(F.lit("trainword"))
    docs = ids.select("doc_id", F.concat(F.lit("some plain words "), F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, F.concat(F.lit(" "), bad, F.lit("! !"))).otherwise(F.lit(""))).alias("text"))
    learned, model = toxicity.train(docs, ids.select("doc_id", "toxic"))
    assert set(learned) == {"trainword"}
    for text in ("some plain words", "you trainword! !", "IDIOT you", None, ""):
        x = toxicity.features(text, learned)
        margin = model.base
        for splits, leaf in model.trees:
            node = 0
            for f, c in splits:
                node = 2 * node + int(x[f[node]] > c[node])
            margin += leaf[node]
        at, value = model.curve
        want = value[0] if margin <= at[0] else value[-1] if margin >= at[-1] else next(value[i] + (value[i + 1] - value[i]) * (margin - at[i]) / (at[i + 1] - at[i]) for i in range(len(at) - 1) if at[i] <= margin <= at[i + 1])
        got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), (learned, model)).first()["toxicity"]
        assert abs(got - want) < 1e-9


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (8, 0), (8, 1), (None, 1), (9, 2)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(empty, model).count() == 0
    bare = toxicity.train(odd, labels.limit(0))
    assert {r["toxicity"] for r in toxicity.score(odd, bare).collect()} == {0.0}


def test_features_see_masked_words():
    x = toxicity.features("you id1ot! YOU $tupid.", {})
    assert len(x) == toxicity.FEATURES
    assert x[11] > 0
    assert toxicity.features("you are an idiot", {})[6] > 0
    assert toxicity.features(None, {}) == [0.0] * toxicity.FEATURES


def test_close_words_of_long_texts_are_counted():
    apart = ["you"] * 1000 + ["word"] * 10 + ["stupid"] * 10
    assert toxicity.features(" ".join(apart), {})[6:8] == [0.0, 0.0]
    x = toxicity.features(" ".join([*apart, "x", "x", "x", "you"]), {})
    assert x[6] == 1 / 1024 and x[7] == np.log1p(1)
    rng = np.random.default_rng(2)
    words = [("you", "stupid", "word", "word")[k] for k in rng.integers(0, 4, 1200)]
    near = sum("you" in words[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1] for i, w in enumerate(words) if w == "stupid")
    assert toxicity.features(" ".join(words), {})[6] == near / 1200


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all()
    assert np.allclose(np.interp([2, 3], x, y), 0.5)


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((2000, toxicity.FEATURES))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] > 0.5) & (x[:, 2] < 0.3))).astype(float)
    s = toxicity.Boosted(x, y).score(x)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97
