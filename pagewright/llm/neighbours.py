"""Approximate nearest neighbours by collision-counting hashing.

Vectors are scaled to length one, where the largest cosine is the least
distance.  Blocks of bounded size hold all vectors; in each, every one of
``projections`` random directions gives one sorted array of projected values.
A query looks at a window centred at its own projection in each array.  Virtual
rehashing widens all windows by the same factor, so only the newly covered ends
of the arrays are read and added to each vector's number of collisions.
Vectors whose collisions reach the threshold are verified: their exact cosine
is taken on the original vectors in double precision.  A query stops in a block
when its k-th best distance is within the window's radius, or all vectors of
the block are verified.  A vector at a distance of the radius collides in 68 %
of the arrays, so with the threshold below that it is missed in one array set
of hundreds; recall is measured against brute force in the tests.

The query set is compared with all blocks in blocks of its own. A data block's
rows come first in its task and are indexed once; query blocks follow and
stream past the index, one at a time. Nothing is broadcast, only the k best of
each block leave a task, and blocks are dealt by id and vector, so an id that
many rows have fills no block by itself.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows of null id; vectors of another length than
the query's are no candidates; rows with the query's id are no candidates; an
id that occurs in several rows counts once as a candidate, by its best row, and
as a query asks with each of its distinct vectors, of which the best score of a
candidate counts; a block with fewer than k candidates returns all of them;
ties go to the smaller id; an empty table or query set gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_batches, table

PROJECTIONS = 96
THRESHOLD = 0.6
WIDEN = 1.25
FIRST_RADIUS = 0.1
BLOCK = 16384
QUERY_BLOCK = 1024
#: rows that travel together
PART = 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(df: DataFrame, blocks: int, rows: int) -> DataFrame:
    """(block, part, ids, vs): the vectors of each block in parts of about ``rows``
    rows; equal rows are one from the map side on."""
    place = F.pmod(F.xxhash64("id", "v"), F.lit(blocks).cast("long"))
    parts = max(1, BLOCK // rows)
    part = F.pmod(F.xxhash64("v", "id"), F.lit(parts).cast("long"))
    spread = df.select("id", F.col("v").cast("array<double>").alias("v")).select("id", "v", place.alias("block"), part.alias("part"))
    packed = spread.groupBy("block", "part").agg(F.collect_set(F.struct("id", "v")).alias("rows"))
    return packed.select("block", "part", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"))


class Index:
    """The sorted projections of one block's vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.unit = vectors / self.norms[:, None]
        self.axes = np.random.default_rng(2024).standard_normal((vectors.shape[1], projections))
        values = (self.unit @ self.axes).T
        self.order = np.argsort(values, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, 1)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        norms = np.sqrt((queries * queries).sum(1))
        centres = (queries / norms[:, None]) @ self.axes
        size, m = len(self.ids), len(self.sorted)
        need = int(np.ceil(THRESHOLD * m))
        radii = [FIRST_RADIUS]
        while radii[-1] < 2.2:
            radii.append(radii[-1] * WIDEN)
        for q, own in enumerate(ids):
            counts = np.zeros(size, np.int64)
            done = self.ids == own
            found, scores = np.zeros(0, np.int64), np.zeros(0)
            ends = None
            for radius in radii:
                near = [(row.searchsorted(c - radius), row.searchsorted(c + radius, "right")) for row, c in zip(self.sorted, centres[q], strict=True)]
                if ends is None:
                    spans = [(j, a, b) for j, (a, b) in enumerate(near)]
                else:
                    spans = [x for j, ((a, b), (c, d)) in enumerate(zip(near, ends, strict=True)) for x in ((j, a, c), (j, d, b))]
                ends = near
                counts += np.bincount(np.concatenate([self.order[j, a:b] for j, a, b in spans]), minlength=size)
                fresh = np.flatnonzero((counts >= need) & ~done)
                if len(fresh):
                    done[fresh] = True
                    dots = (self.vectors[fresh] * queries[q]).sum(1)
                    found = np.concatenate([found, fresh])
                    scores = np.concatenate([scores, dots / (self.norms[fresh] * norms[q])])
                    best = np.lexsort((self.ids[found], -scores))[: k]
                    reach = scores[best[-1]] if len(best) == k else -2.0
                    if np.sqrt(max(0.0, 2 - 2 * reach)) <= radius or done.all():
                        break
            if len(found) < k and not done.all():
                # far vectors that no window reached often enough
                fresh = np.flatnonzero(~done)
                found = np.concatenate([found, fresh])
                scores = np.concatenate([scores, (self.vectors[fresh] * queries[q]).sum(1) / (self.norms[fresh] * norms[q])])
            best = np.lexsort((self.ids[found], -scores))[:k]
            for i in best:
                yield int(own), int(self.ids[found[i]]), float(scores[i])


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found of each row for which
    ``queries`` holds."""
    small_batches(vectors.sparkSession)
    chosen = vectors.where(F.col(key).isNotNull() & usable(F.col(column))).select(F.col(key).alias("id"), F.col(column).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    size, asked = chosen.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-size // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    data = _packed(chosen, blocks, PART).withColumn("asks", F.lit(False))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asks = _packed(chosen.where("asks"), query_blocks, BLOCK).select(every.alias("block"), F.col("block").alias("part"), "ids", "vs", F.lit(True).alias("asks"))

    def matrices(one: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: ids and vectors of one row."""
        ids, vs = one.column("ids")[0], one.column("vs")[0]
        ids, ends, flat = ids.values.to_numpy(), vs.values.offsets.to_numpy(), vs.values.values.to_numpy()
        lengths = np.diff(ends)
        return {int(n): (ids[lengths == n], np.stack([flat[ends[i] : ends[i] + n] for i in np.flatnonzero(lengths == n)])) for n in np.unique(lengths)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, indexes = None, {}, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                if one.column("block")[0].as_py() != block:
                    block, held, indexes = one.column("block")[0].as_py(), {}, None
                if not one.column("asks")[0].as_py():
                    for n, x in matrices(one).items():
                        held.setdefault(n, []).append(x)
                    continue
                if indexes is None:
                    indexes = {n: Index(np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])) for n, x in held.items()}
                    held = {}
                found = [x for n, (ids, vs) in matrices(one).items() if n in indexes for x in indexes[n].nearest(ids, vs, k)]
                a, b, c = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "id", "score"])

    # more tasks than blocks, so that few of them get two
    pairs = data.unionByName(asks).repartition(blocks * (16 if blocks < 64 else 2), "block").sortWithinPartitions("block", "asks", "part")
    best = pairs.mapInArrow(run, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
