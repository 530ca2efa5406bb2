"""Whitening against a dense eigendecomposition on exact integers."""

import math

import numpy as np
import pytest

from pagewright.llm.registry import queries
from pagewright.llm.whitening import one_sided_jacobi, whitened

SCHEMA = "vec_id long, embedding array<double>, n string"


def plain(rows, most=32):
    kept = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept), strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for _, x in kept])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    scores = centred @ axes[:, :k] / np.sqrt(values[:k])
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in kept]
    return [i for i, _ in kept], n, deviations, scores, values[:k] / values.sum()


def check(df, rows, key):
    ids, n, deviations, scores, shares = plain(rows)
    got = df.toPandas()
    assert len(got) == scores.size and (got["n"] == n).all()
    assert sorted(zip(got[key], got["component"], got["deviation"], strict=True)) == sorted((i, c + 1, d) for i, d in zip(ids, deviations, strict=True) for c in range(len(shares)))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    table = got.pivot(index=key, columns="component", values="whitened").loc[ids].to_numpy()
    same, other = np.abs(table - scores).max(0), np.abs(table + scores).max(0)
    assert np.minimum(same, other).max() < 1e-7
    explained = got.groupby("component")["explained"].agg(["min", "max"])
    assert (explained["min"] == explained["max"]).all() and np.abs(explained["min"].to_numpy() / shares - 1).max() < 1e-9


def test_whole_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries()["op13_whitening"](spark, folder), rows, "vec_id")


@pytest.mark.parametrize("parts", [1, 9])
def test_small_dimension_constant_column_and_bad_rows(spark, parts):
    r = np.random.default_rng(3)
    rows = [(i, [*(float(x) for x in r.normal(size=4) * [9, 3, 1, 0.2]), 7.0]) for i in range(50)]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, []), (95, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], SCHEMA).repartition(parts)
    check(whitened(df), rows, "id")


def test_no_variance_and_empty(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)).collect() == []
    two = whitened(spark.createDataFrame([(1, [1.0, 2.0], ""), (1, [3.0, 2.0], ""), (None, [3.0, 2.0], "")], SCHEMA)).collect()
    assert {r["component"] for r in two} == {1} and len(two) == 3 and {r["n"] for r in two} == {3}


def test_large_components_do_not_crash(spark):
    rows = [(i, [1e300 * (-1) ** i, float(i)], "") for i in range(4)]
    assert {r["deviation"] for r in whitened(spark.createDataFrame(rows, SCHEMA)).collect()} == {None}


@pytest.mark.parametrize("dim", [1, 2, 7, 32])
def test_jacobi_keeps_small_singular_values(dim):
    r = np.random.default_rng(dim)
    q, _ = np.linalg.qr(r.normal(size=(dim, dim)))
    want = 10.0 ** -np.arange(dim)[:12]
    m = np.zeros((dim, dim))
    m[: len(want)] = want[:, None] * q[: len(want)]
    lengths, axes = one_sided_jacobi(m)
    assert np.abs(axes.T @ axes - np.eye(dim)).max() < 1e-12
    assert np.abs(lengths[: len(want)] / want - 1).max() < 1e-10
