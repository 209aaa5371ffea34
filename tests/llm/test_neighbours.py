from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlmill.llm import neighbours as nn
from crawlmill.llm import queries

SCHEMA = "id long, embedding array<float>"


def exact(ids, x, k):
    s = x @ x.T
    s[np.arange(len(x)), np.arange(len(x))] = -2
    out = {}
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (-round(float(s[i, j]), 5), ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order if j != i]
    return out


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, None), (2, [1.0] * 63), (3, [0.0] * 64), (4, [float("nan")] + [1.0] * 63), (5, [float("inf")] + [1.0] * 63), (6, [None] + [1.0] * 63), (None, [1.0] * 64), (7, [3e38] * 64), (8, [2.0] * 64)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("vec", F.lit("clash"))
    got = {r.id: np.frombuffer(r.vec, np.float32) for r in nn.usable_vectors(docs).collect()}
    assert set(got) == {7, 8} and np.allclose(got[7], got[8])
    assert [tuple(r)[:2] for r in nn.neighbours(nn.usable_vectors(docs)).orderBy("id").collect()] == [(7, 8), (8, 7)]
    assert nn.neighbours(nn.usable_vectors(docs.limit(0))).count() == 0


@pytest.mark.parametrize("block", [4096, 50])
def test_recall(spark, block):
    g = np.random.default_rng(7)
    centre = g.normal(size=(40, 64))
    x = (centre[g.integers(0, 40, 1500)] + 0.6 * g.normal(size=(1500, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(0, 3000, 2))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], SCHEMA)
    found = nn.neighbours(nn.usable_vectors(docs), nn.KnnSettings(list_size=64, probes=8, prune=2.0, block=block)).toPandas()
    want, got = exact(ids, x, 10), found.groupby("id").other.apply(set)
    assert found.groupby("id").size().max() == 10 and not found.duplicated(["id", "other"]).any()
    assert np.mean([len(got.get(i, set()) & set(w)) / 10 for i, w in want.items()]) > 0.9


def test_copies_of_one_vector(spark):
    g = np.random.default_rng(8)
    rows = [(i, [1.0] * 64) for i in range(30)] + [(100 + i, g.normal(size=64).tolist()) for i in range(60)] + [(200, [1.0] * 63 + [1.01])] + [(300, [2.0] + [0.0] * 63), (301, [3.0] + [0.0] * 63)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = nn.neighbours(nn.usable_vectors(docs), nn.KnnSettings(list_size=16)).toPandas()
    by = found.groupby("id").other.apply(sorted)
    assert by[20] == list(range(10)) and by[3] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert by[200] == list(range(10)) and 301 in by[300] and 300 in by[301]
    pairs = {tuple(r) for r in nn.similar_pairs(spark.createDataFrame(found), 0.85).collect()}
    assert (300, 301) in pairs and (0, 200) in pairs and all(a < b for a, b in pairs)


def test_pairs_of_the_pages_equal_brute_force(spark):
    root = "/root/testdata/sf0.01"
    v = nn.usable_vectors(spark.read.parquet(f"{root}/pages.parquet")).toPandas()
    ids, x = v.id.tolist(), np.frombuffer(b"".join(v.vec), np.float32).reshape(-1, 64)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.85}
    assert {tuple(r) for r in queries.p2_found(spark, root).collect()} == want


def test_search_of_a_twentieth(spark):
    root = "/root/testdata/sf0.01"
    found = queries.p2_search(spark, root).toPandas()
    assert (found.id % 20 == 0).all() and (found.groupby("id").size() == 10).all()
    v = nn.usable_vectors(spark.read.parquet(f"{root}/pages.parquet")).toPandas()
    x = np.frombuffer(b"".join(v.vec), np.float32).reshape(-1, 64)
    want, got = exact(v.id.tolist(), x, 10), found.groupby("id").other.apply(set)
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in got.index]) > 0.9


def test_search_follows_the_number_of_lists(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(8000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    settings = replace(queries.SEARCH, list_size=32)  # 250 lists
    found = nn.neighbours(nn.usable_vectors(docs), settings, "id % 20 = 0").toPandas()
    got = found.groupby("id").other.apply(set)
    own = x[::20] @ x.T
    own[np.arange(400), np.arange(0, 8000, 20)] = -2
    want = np.argsort(-own, 1)[:, :10].tolist()
    assert len(got) == 400 and np.mean([len(got[20 * i] & set(w)) / 10 for i, w in enumerate(want)]) > 0.975


def test_balanced_centroids():
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(size=(900, 8)) * 0.05 + 1, g.normal(size=(100, 8))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = nn.fit_centroids(x, 20, 8)
    assert c.shape == (20, 8) and np.bincount((x @ c.T).argmax(1), minlength=20).max() < 400
    graph = nn.CentroidGraph(c, 8)
    lists, _ = graph.nearest(x, 4)
    assert np.mean(lists[:, 0] == (x @ c.T).argmax(1)) > 0.95
