"""The record store: touched buckets only, no lost writes, one bucket a read."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from pagewright.operators import store

SCHEMA = "doc_id long, name string, summary string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def folders(path):
    return {f[len(path) :] for f in glob.glob(f"{path}/data/*/bucket=*")}


def test_an_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    first = [(i, f"n{i}", "old") for i in range(200)]
    store.save(frame(spark, first), path, ["doc_id", "name"], buckets=32)
    before = folders(path)
    assert len(before) == 32
    store.save(frame(spark, [(3, "n3", "new"), (900, "x", "new")]), path, ["doc_id", "name"])
    assert 1 <= len(folders(path) - before) <= 2
    want = [(i, f"n{i}", "new" if i == 3 else "old") for i in range(200)] + [(900, "x", "new")]
    assert rows(store.load(spark, path)) == sorted(want, key=str)


def test_a_point_read_opens_one_bucket(spark, tmp_path):
    path = str(tmp_path / "s")
    store.save(frame(spark, [(i, f"n{i}", "s") for i in range(100)]), path, ["doc_id"], buckets=16)
    found = store.read_key(spark, path, doc_id=42)
    (file,) = {os.path.dirname(f) for f in found.inputFiles()}
    for other in glob.glob(f"{path}/data/*/bucket=*"):
        if not file.endswith(other):
            for f in glob.glob(f"{other}/*.parquet"):
                os.remove(f)
    assert rows(found) == [(42, "n42", "s")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(doc_id,42)" in plan
    with pytest.raises(ValueError):
        store.read_key(spark, path, name="n42")


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "s"), []

    def write(n):
        try:
            store.save(frame(spark, [(i, f"w{n}", f"{n}") for i in range(n, 40, 3)] + [(1000 + n, "own", f"{n}")]), path, ["doc_id"], buckets=4)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    want = [(i, f"w{i % 3}", f"{i % 3}") for i in range(40)] + [(1000 + n, "own", f"{n}") for n in range(3)]
    assert rows(store.load(spark, path)) == sorted(want, key=str)
    assert len(glob.glob(f"{path}/manifest/0*.json")) == 3


def test_another_writer_between_read_and_commit(spark, tmp_path, monkeypatch):
    path, commit, once = str(tmp_path / "s"), store._commit, []
    store.save(frame(spark, [(1, "a", "x"), (2, "b", "y")]), path, ["doc_id"], buckets=1)

    def interrupted(spark, at, manifest):
        if not once:
            once.append(1)
            store.save(frame(spark, [(1, "other")], "doc_id long, name string"), path, ["doc_id"])
        return commit(spark, at, manifest)

    monkeypatch.setattr(store, "_commit", interrupted)
    assert store.save(frame(spark, [(2, "mine"), (3, "new")], "doc_id long, name string"), path, ["doc_id"]) == 2
    assert rows(store.load(spark, path)) == [(1, "other", "x"), (2, "mine", "y"), (3, "new", None)]
    assert store.vacuum(spark, path) >= 2 and len(rows(store.load(spark, path))) == 3


def test_null_keys_empty_saves_and_wrong_keys(spark, tmp_path):
    path = str(tmp_path / "s")
    assert store.load(spark, path) is None and store.vacuum(spark, path) == 0
    store.save(frame(spark, []), path, ["doc_id"])
    assert rows(store.load(spark, path)) == []
    version = store.save(frame(spark, [(None, "n", "s"), (1, "a", None)]), path, ["doc_id"])
    assert store.save(frame(spark, []), path, ["doc_id"]) == version
    store.save(frame(spark, [(None, "m", "s")]), path, ["doc_id"])
    assert rows(store.load(spark, path)) == [(1, "a", None), (None, "m", "s")]
    assert rows(store.read_key(spark, path, doc_id=None)) == [(None, "m", "s")]
    with pytest.raises(ValueError):
        store.save(frame(spark, [(1, "a", "b")]), path, ["name"])
    with pytest.raises(ValueError):
        store.save(frame(spark, [(1, "a", "b"), (1, "b", "c")]), path, ["doc_id"])
    assert store.load(spark, path).where(F.col("doc_id") == 1).count() == 1
