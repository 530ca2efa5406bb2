"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has a bit set where over half of its shingle hashes
have it set.  Every bit position gets a nonzero vector of ``radius + 1`` bits;
for each nonzero vector v one table keeps the bits whose vector has an odd
product with v.  At most ``radius`` positions leave some v with an even product
with all of them, so two fingerprints that differ in at most ``radius`` bits
agree on all bits which that table keeps: every such pair meets in some table.

Equal fingerprints are one node from the start.  Within a bucket the nodes are
compared by blocks of bounded size, so a large bucket is many tasks, and each
block pair gives only a star for each class of its links: no bucket's pairs are
ever listed, and none is left out.

Defined cases: null text is empty text; texts of no word have fingerprint zero
and are linked to each other like any others; repeated rows are kept, each
with its class; a null doc_id stands in a class but never names one (a class
of null ids only has component_id null); long texts are counted in pieces of
fixed size; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HOT, cut, joined_by_share, joined_by_size, pieces, small_batches, table, texts
from .components import components

BLOCK = 2048
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x20\x09-\x0d]+").findall


def fingerprint(text: str, shingle: int = 3) -> int:
    words = WORDS(text.translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(" ".join(words).encode(), 42)]
    elif shingle == 3:
        hashes = [digest(f"{a} {b} {c}".encode(), 42) for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [digest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8")
    for at in range(0, n, 8192):
        counts += np.unpackbits(values[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", column: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    docs = docs.select(key, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[key, "fp"])

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def masks(radius: int) -> list[int]:
    """One mask of kept bits for each table, as 64-bit integers."""
    size = 1 << (radius + 1)
    # a fixed scramble spreads the vectors over the positions
    vectors = [1 + (i * 7 + i // (size - 1)) % (size - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size)]


def stars(nodes: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """(least node, node) for all other nodes of a class; ``group`` holds for each
    node the place of one node of its class. Blocks that see the same class give
    the same links, so that few rounds are left to do between blocks."""
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, group, nodes)
    tied = least[group] != nodes
    return list(zip(least[group][tied].tolist(), nodes[tied].tolist(), strict=True))


def _classes(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Stars of the classes of all pairs within the radius; left and
    right are either the same block or disjoint ones of one bucket."""
    nodes = left if left is right else np.concatenate([left, right])
    shift, group = 0 if left is right else len(left), np.arange(len(nodes))
    for i in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(right ^ left[i]) <= radius) + shift
        near = near[group[near] != group[i]]
        while len(near):
            group[group == group[near[0]]] = group[i]
            near = near[group[near] != group[i]]
    return stars(nodes.view(np.int64), group)


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: ties of a node to another of its
    class, which give the classes of all pairs within ``radius`` bits."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("kept")) for i, m in enumerate(masks(radius))])
    keys = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.kept")
    shared = keys.groupBy("t", "kept").agg(F.count("*").alias("n")).where("n > 1")
    # a bucket of n nodes is dealt into ceil(n / block) parts; part pair (i, j) is one group
    parts = F.ceil(F.col("n") / block).cast("int")
    member = joined_by_size(keys, shared, ["t", "kept"], hot=hot).withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    other = F.explode(F.expr("sequence(0, parts - 1)")).alias("q")
    dealt = member.select("t", "kept", "fp", "p", other).select("t", "kept", "fp", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p")
    # small groups travel packed: one row holds the nodes of one part
    packed = dealt.groupBy("t", "kept", "i", "j").agg(F.collect_list(F.struct("p", "fp")).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            i, j, nodes = (batch.column(n) for n in ("i", "j", "nodes"))
            ends, flat = nodes.offsets.to_numpy(), nodes.values
            part = flat.field("p").to_numpy()
            value = flat.field("fp").to_numpy().view(np.uint64)
            for row in range(batch.num_rows):
                p, v = part[ends[row] : ends[row + 1]], value[ends[row] : ends[row + 1]]
                if len(v) == 2 and i[row] == j[row]:
                    if int(v[0] ^ v[1]).bit_count() <= radius:
                        found.append(tuple(v.view(np.int64).tolist()))
                elif i[row] == j[row]:
                    found += _classes(v, v, radius)
                else:
                    found += _classes(v[p == i[row].as_py()], v[p != i[row].as_py()], radius)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return packed.select("i", "j", "nodes").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", column: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row for each document: key, fp, component_id (the least key of its class)."""
    marked = cut(fingerprints(docs, key, column, shingle))
    nodes = cut(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    classes = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = cut(named.groupBy("root").agg(F.min("least").alias("component_id")).join(named, "root").select("fp", "n", "component_id"))
    return joined_by_share(marked, ids, ["fp"]).drop("n")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
