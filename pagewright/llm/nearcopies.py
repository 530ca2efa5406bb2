"""Near copies: SimHash classes and MinHash bands for candidates, exact sets for links.

A document is the set of its five-word shingles.  Candidates come in two ways.
SimHash, as in ``simhash``: fingerprints that differ in ``RADIUS`` bits or fewer
are linked by covering tables, and what is in one class of them is one group.
This finds copies with few edits whatever their length; a similarity of 0.8 is
some ten bits apart, beyond any table of such fingerprints.  So ``BANDS`` keys of
``ROWS`` MinHash values each bring documents together as well: a pair of
similarity s shares no key with probability (1 - s**ROWS)**BANDS, which is 3e-6
at 0.8.  Within a group the whole shingle sets (64-bit hashes) are compared, and
only pairs at ``LEAST`` or over are links; classes are the connected components.

Equal sets are one node from the start.  A large group is dealt into parts of
bounded rows and bytes, part pairs are compared apart, and each gives only a
star for each class of its links: no group's pairs are ever listed, and none
is left out.  Groups of the same members under several keys are compared once.

Defined cases: null text is empty text; words are as in ``simhash``; a text of
fewer than five words is one shingle, texts of no word have the empty set and
are linked to each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from ._shared import HOT, cut, joined_by_share, joined_by_size, pieces, small_batches, texts
from .components import components
from .simhash import LOWER, WORDS

SHINGLE = 5
LEAST = 0.8
#: bits in which linked fingerprints may differ
RADIUS = 3
BANDS = 32
ROWS = 5
BLOCK = 1024
#: shingles in one slice of a group's matrix
SLICE = 2048
BLOCK_BYTES = 4 << 20
_random = np.random.default_rng(11)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = WORDS(text.translate(LOWER))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(" ".join(words[i : i + SHINGLE]).encode(), 42) for i in range(max(1, len(words) - SHINGLE + 1))] if words else [], np.uint64))


def bands(grams: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(grams), 512):
        np.minimum(least, (grams[at : at + 512, None] * FACTORS + SHIFTS).min(0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def sketches(docs: DataFrame, column: str, *others: str) -> DataFrame:
    """(others, node, size, fp, bands): node names the shingle set, size counts it,
    fp is the text's SimHash fingerprint."""
    small_batches(docs.sparkSession)
    docs = docs.select(*others, column)
    schema = T.StructType([*docs.schema.fields[:-1], *(T.StructField(n, T.LongType()) for n in ("node", "size", "fp")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held = texts(batch.column(len(others)))
            sets = [shingles(t) for t in held]
            prints = np.array([simhash.fingerprint(t) for t in held], np.uint64).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            flat = np.concatenate([bands(s) for s in sets]).view(np.int64) if sets else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints), keys], names=schema.names)

    return docs.mapInArrow(run, schema)


def sets_of(docs: DataFrame, column: str) -> DataFrame:
    """(node, grams) for (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams = pa.array([shingles(t).tobytes() for t in texts(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["node", "grams"])

    return docs.select("node", column).mapInArrow(run, "node long, grams binary")


def tied(nodes: np.ndarray, sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Stars of the classes of all pairs whose Jaccard is ``least`` or over.
    Intersections of all pairs are one product of the 0/1 matrix of nodes and the
    shingles that at least two nodes have, taken slice by slice of the shingles."""
    size, sizes = len(sets), np.array([len(s) for s in sets])
    grams, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(size), sizes)
    held = np.bincount(flat, minlength=len(grams))
    place = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[flat]
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((size, size), np.float32)
    for at in range(0, int((held > 1).sum()), SLICE):
        part = slice(*np.searchsorted(place, (at, at + SLICE)))
        seen = np.zeros((size, SLICE), np.float32)
        seen[owner[part], place[part] - at] = 1
        both += seen @ seen.T
    group = np.arange(size)
    for i in range(size - 1):
        # in whole numbers of thousandths, so that a similarity of just 0.8 counts
        near = np.flatnonzero(both[i, i + 1 :].astype(np.int64) * 1000 >= round(least * 1000) * (sizes[i] + sizes[i + 1 :] - both[i, i + 1 :].astype(np.int64))) + i + 1
        near = near[group[near] != group[i]]
        while len(near):
            group[group == group[near[0]]] = group[i]
            near = near[group[near] != group[i]]
    return simhash.stars(nodes, group)


def simhash_keys(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, size, k): one key for each SimHash class that (node, size, fp) rows
    have a text in; keys of single fingerprints with a single row are left out."""
    prints = cut(marked.groupBy("fp").agg(F.count("*").alias("n")))
    linked = components(simhash.links(prints.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    shared = cut(prints.join(linked, "fp", "left").where("root is not null or n > 1").select("fp", "n", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("k")))
    return joined_by_share(marked.select("node", "size", "fp"), shared, ["fp"]).select("node", "size", "k").distinct()


def groups(nodes: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, hot: int = HOT, more: DataFrame | None = None) -> DataFrame:
    """(g, node): groups of nodes that share a band key or a key of ``more`` (node,
    size, k), in parts and part pairs. Rows may repeat a node."""
    keys = nodes.select("node", "size", F.explode("bands").alias("k"))
    if more is not None:
        keys = keys.unionByName(more)
    # few keys are shared; written once, they aren't counted again for each use
    shared = cut(keys.groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("held")).where("n > 1"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("held") * 8 / block_bytes), F.lit(1)).cast("int")
    member = joined_by_size(keys.select("k", "node"), shared, ["k"], hot=hot).select("k", "node", parts.alias("parts")).withColumn("p", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = member.select("k", "node", "p", F.explode(F.expr("sequence(0, parts - 1)")).alias("q"))
    packed = dealt.groupBy("k", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    one = packed.where(F.size("nodes") > 1).select(F.xxhash64("nodes").alias("g"), "nodes").dropDuplicates(["g", "nodes"])
    # groups of one g by chance are compared as one, where a node may stand twice
    return one.select("g", F.explode("nodes").alias("node"))


def links(member: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): ties of a node to another of its class; classes are those of the
    verified links among all pairs within a group."""
    packed = member.join(sets, "node").groupBy("g").agg(F.collect_list(F.struct("node", "grams")).alias("held")).select("held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], batch.column(0)
            ends, node, grams = held.offsets.to_numpy(), held.values.field("node"), held.values.field("grams")
            for row in range(batch.num_rows):
                part = range(ends[row], ends[row + 1])
                found += tied(node.to_numpy()[ends[row] : ends[row + 1]], [np.frombuffer(grams[i].as_py(), np.uint64) for i in part])
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return packed.mapInArrow(run, "a long, b long").distinct()


def _roots(nodes: DataFrame, marked: DataFrame, docs: DataFrame, key: str, column: str) -> DataFrame:
    """(node, root) of the nodes that are linked; ``nodes`` holds node and key (of a
    row with its text), ``marked`` node, size, fingerprint and bands."""
    member = cut(groups(marked, more=cut(simhash_keys(marked))))
    # texts of nodes in a group are read again, one row for each node
    wanted = nodes.select("node", key).join(member.select("node").distinct(), "node", "left_semi")
    held = docs.select(key, column).join(wanted, key).dropDuplicates(["node"])
    return components(links(member, sets_of(held, column))).select("node", "root")


def classes(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, root): the class of each distinct row key. ``key`` must tell rows of
    different texts apart; any one of the rows that repeat a key is read."""
    marked = cut(sketches(docs, column, key))
    nodes = marked.groupBy("node").agg(F.min(key).alias(key))
    prints = marked.groupBy("node", "fp").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    found = cut(_roots(nodes, prints, docs, key, column))
    return marked.select(key, "node").distinct().join(found, "node", "left").select(key, F.coalesce("root", "node").alias("root"))


def leaders(docs: DataFrame, key: str, order: list[str], column: str = "text") -> DataFrame:
    """(key): of each class the row that comes first by ``order``, then key.
    Copies are folded on the map side before anything is joined."""
    first = F.struct(*order, key)
    # texts of one shingle set may differ in words repeated or in order, and so in fingerprint
    marked = cut(sketches(docs, column, key, *order).groupBy("node", "fp").agg(F.min(first).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    nodes = cut(marked.groupBy("node").agg(F.min("first").alias("first")).withColumn(key, F.col("first")[key]))
    roots = _roots(nodes, marked, docs, key, column)
    classed = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    return classed.agg(F.min("first").alias("first")).select(F.col("first")[key].alias(key))
