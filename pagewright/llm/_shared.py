"""Helpers that the training-data operators have in common."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut, shared_folder

__all__ = ["cut", "joined_by_share", "joined_by_size", "labelled_texts", "pieces", "removed", "shared_folder", "small_batches", "table", "texts", "training_rows"]

BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
#: bytes of text that a classifier learns from, whole texts
TRAIN_BYTES = 64 << 20
#: rows of one key that may meet in one task
HOT = 100_000


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of one Arrow batch, so that Python workers hold
    a few MB of text whatever the length of the documents. The two settings are
    read when a plan runs, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def joined_by_size(rows: DataFrame, counted: DataFrame, on: list[str], n: str = "n", hot: int = HOT) -> DataFrame:
    """``rows`` joined to ``counted``, which has one row for each key with the
    number ``n`` of its rows. Keys of over ``hot`` rows are broadcast - there are
    at most ``1 / hot`` times as many as rows - so that the rows of such a key
    stay where they are and no task gets them all; the others meet by key."""
    large = F.broadcast(counted.where(F.col(n) > hot))
    rest = rows.join(large.select(*on), on, "left_anti").join(counted.where(F.col(n) <= hot), on)
    return rows.join(large, on).unionByName(rest)


def joined_by_share(rows: DataFrame, counted: DataFrame, on: list[str], n: str = "n", share: int = 1000) -> DataFrame:
    """``rows`` joined to ``counted``, which has one row for each key with the
    number ``n`` of its rows. Keys that hold over one ``share``-th of all rows are
    broadcast - there are fewer than ``share`` of them, whatever the input - and
    their rows stay where they are; the others meet by key."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    large = F.broadcast(counted.where(F.col(n) > total / share))
    rest = rows.join(large.select(*on), on, "left_anti").join(counted.where(F.col(n) <= total / share), on)
    return rows.join(large, on).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one test table; only these are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int, most_bytes: int = TRAIN_BYTES) -> list[tuple[str, object]]:
    """(text, label) of at most ``limit`` labelled keys, those of least hash, as
    far as their texts hold ``most_bytes`` together: rows and bytes that reach
    the driver are bounded. Keys with their labels are chosen first, so that
    texts of no other row are moved; the chosen keys are broadcast.

    Which text of a key a label speaks of is only known if the key has one text
    and one label: keys with several are left out; repeated rows count once."""
    drawn = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
    named = drawn.where("_y = _z").select("_k", "_y")
    found = docs.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t")).join(_least_keys(named, limit), "_k")
    found = found.groupBy("_k", "_y", "_h").agg(F.min("_t").alias("_t"), F.max("_t").alias("_u")).where("_t = _u")
    return _bounded(found, most_bytes, limit)


def labelled_texts(docs: DataFrame, key: str, text: str, label: str, limit: int, most_bytes: int = TRAIN_BYTES) -> list[tuple[str, object]]:
    """The same where text and label stand in one row of ``docs``: distinct
    (text, label) rows of the chosen keys, each text with its own label."""
    rows = docs.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("_y"), F.coalesce(text, F.lit("")).alias("_t"))
    chosen = _least_keys(rows.select("_k").distinct(), limit)
    return _bounded(rows.join(chosen, "_k").select("_y", "_t", "_h").distinct(), most_bytes, limit)


def _least_keys(keys: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(keys.withColumn("_h", F.xxhash64(F.col("_k").cast("string"))).orderBy("_h", "_k").limit(limit))


def _bounded(found: DataFrame, most_bytes: int, most_rows: int) -> list[tuple[str, object]]:
    """Rows by hash as long as the sum of their bytes is within the bound. Names of
    rows - hash, label, digest and bytes of the text - are cut to ``most_rows``
    first, so that no text moves before it is chosen, whatever a key holds."""
    named = found.select("_t", "_y", "_h", F.xxhash64("_t").alias("_x"), F.octet_length("_t").cast("long").alias("_b"))
    first = named.select("_h", "_y", "_x", "_b").orderBy("_h", "_y", "_x").limit(most_rows)
    order = Window.orderBy("_h", "_y", "_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = first.withColumn("_b", F.sum("_b").over(order)).where(F.col("_b") <= most_bytes).drop("_b")
    chosen = named.join(F.broadcast(held), ["_h", "_y", "_x"]).select("_h", "_y", "_x", "_t").collect()
    return [(r[3], r[1]) for r in sorted(chosen, key=lambda r: r[:3])]


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
