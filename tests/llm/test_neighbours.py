import math

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import neighbours


def brute(ids, vectors, k):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = unit @ unit.T
    return {int(ids[q]): [int(ids[i]) for i in np.lexsort((ids, -scores[q])) if i != q][:k] for q in np.flatnonzero(ids % 20 == 0)}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors, ids = rng.standard_normal((3000, 48)), np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0.0) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, score double")
    got: dict[int, list] = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = brute(ids, vectors, 5)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.id, r.score) for r in neighbours.nearest(df, F.col("vec_id").isin(0, 3, 4, 10)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (3, 1, 0, 0.0), (3, 2, 1, 0.0), (3, 3, 2, 0.0)]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(df, F.lit(False)).count() == 0


def test_several_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    monkeypatch.setattr(neighbours, "PART", 64)
    rng = np.random.default_rng(4)
    vectors, ids = rng.standard_normal((1500, 24)), np.arange(1500)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)] + [(7, vectors[7].tolist())] * 600
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got: dict[int, list] = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = brute(ids, vectors, 5)
    assert set(got) == set(want) and all(len(set(x)) == 5 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.95


def test_a_query_id_asks_with_each_of_its_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0]), (4, [-1.0, -0.9])]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n)
        got = [(r.rank, r.id) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
        assert got == [(1, 1), (2, 2), (3, 4), (4, 3)]


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.where("embedding is not null").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got: dict[int, set] = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(got[int(ids[q])] & set(ids[np.lexsort((ids, -scores))[:5]].tolist()))
    assert hits / (5 * len(got)) >= 0.95
