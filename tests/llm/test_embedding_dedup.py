import os

import numpy as np
import pytest

from loomgraph.llm.embedding_dedup import near_vectors


def brute(rows):
    ids = [r[0] for r in rows]
    ok = [r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(v != 0 for v in r[1]) for r in rows]
    n, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2]:
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    n[ids[i]] += 1
                    n[ids[j]] += 1
                    p, q = find(ids[i]), find(ids[j])
                    root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in ids}


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, centres = [], rng.standard_normal((12, 32))
    for i in range(400):
        v = centres[i % 12] + rng.standard_normal(32) * (0.1 if i % 3 else 0.3)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(400 + i, rows[0][1], 0) for i in range(30)]
    rows += [(500, None, 0), (501, [0.0] * 32, 0), (502, [float("nan")] * 32, 0), (503, rows[0][1], None), (504, [None] * 32, 0), (505, [], 0), (506, [float("inf")] * 32, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    for part in (2048, 32):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, part=part).collect()}
        assert got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in near_vectors(df).collect())


def test_odd_tables(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = spark.createDataFrame([(1, None, 0, "x"), (None, [1.0, 0.0], 0, "y"), (2, [1.0, 0.0], 0, "z"), (2, [1.0, 0.0], 0, "z")], "vec_id long, embedding array<float>, label int, rep string")
    got = near_vectors(one).collect()
    assert len(got) == 4
    assert sorted((r["n_links"] for r in got if r["vec_id"] == 2)) == [1, 1]


def _pairs(rng, n, dim, mean, cosine):
    """n unit vectors about a common direction, and a copy of each turned to the cosine."""
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    off = rng.standard_normal((n, dim))
    off[:, 0] = 0
    x = np.sqrt(1 - mean * mean) * unit(off)
    x[:, 0] += mean
    u = rng.standard_normal((n, dim))
    u = unit(u - (u * x).sum(axis=1, keepdims=True) * x)
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine * cosine) * u])


def test_vectors_with_a_common_mean_equal_brute_force(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(_pairs(np.random.default_rng(8), 200, 64, 0.95, 0.981))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    assert sum(n for n, _ in want.values()) >= 400
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, bits=14).collect()}
    assert got == want


def test_each_dimension_is_linked(spark):
    rng = np.random.default_rng(9)
    each = [[(1000 * d + i, v.tolist(), 0) for i, v in enumerate(_pairs(rng, 20, d, 0.0, 0.99))] for d in (16, 24)]
    df = spark.createDataFrame(each[0] + each[1], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert got == brute(each[0]) | brute(each[1])
    assert all(n >= 1 for n, _ in got.values())


def test_two_vectors_and_dense_groups_equal_brute_force(spark):
    """Two vectors alone lie on both sides of their mean; links about a common mean may differ in half of their bits."""
    v = np.random.default_rng(0).standard_normal(32)
    rows = [(0, v.tolist(), 0), (1, (v + 1e-3).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()} == brute(rows) == {0: (1, 0), 1: (1, 0)}
    rng = np.random.default_rng(1)
    mean = rng.standard_normal(64)
    rows = [(i, (mean + 0.13 * rng.standard_normal(64)).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    assert sum(n for n, _ in want.values()) > 50_000
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()} == want
    found = sum(r["n_links"] for r in near_vectors(df, bits=6).collect())
    assert found >= 0.98 * sum(n for n, _ in want.values())


def test_recall_of_queries_against_all_rows(spark):
    """Every row whose id is divisible by 100, against all: links found and links there are."""
    import duckdb

    path = "/root/testdata/check_s/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("without the larger tables")
    want = duckdb.sql(f"""select a.vec_id, count(*) from '{path}/*.parquet' a join '{path}/*.parquet' b on a.label = b.label and a.vec_id <> b.vec_id
        where a.vec_id % 100 = 0 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.98 group by 1""").fetchall()
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.read.parquet(path)).collect()}
    assert sum(n for _, n in want) > 0
    assert sum(got[i] for i, _ in want) >= 0.999 * sum(n for _, n in want)


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (3, [1.0, 0.0], "y"), (4, [1.0, 0.0], None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
