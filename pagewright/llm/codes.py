"""Vector codes: product quantisation by integer k-means, searched with vantage-point trees.

Components become integers, vectors are cut into equal consecutive parts, and
each part position has a codebook of its own.  Codebooks start as parts of the
vectors of least id.  A round assigns every part to its nearest entry and moves
each entry to the floor of its parts' mean.  All arithmetic that decides is on
integers, so the result is the same however Spark deals the rows.

The nearest entry is found in a vantage-point tree over the entries of one part
position.  Branches are ruled out by the triangle inequality on distances whose
roundings are moved outwards, a branch that could just tie is visited, and what
is visited is compared by exact squared distances, ties to the lower index.  A
task walks one tree with all its parts at once, as arrays.

A round is one pass over the vectors: a task returns one sum and one count for
each entry, these are added by entry, and only the codebooks (``entries`` times
the dimension) reach the driver and the next pass.

Defined cases: rows whose vector is null or empty, or holds null or non-finite
components, take no part; the dimension is that of the vector of least id whose
length the parts divide, and rows of any other length take no part; components
beyond a long count as its ends, and an error that a long can't hold is null;
an id of several rows seeds one entry, by its least vector, and each of its rows
is coded; rows of null id are coded and seed nothing unless all ids are null (then
codes, errors and digest are null); fewer ids than entries make a smaller
codebook; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, joined_by_share, small_batches, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: entries of a tree's leaf
LEAF = 8
LONG = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether a vector holds numbers only, and at least one."""
    each = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(each & (F.size(vector) > 0), F.lit(False))


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as longs, within a long's range."""
    scaled = np.floor(flat.astype(np.float64) * scale)
    inside = np.abs(scaled) < 2.0**63
    return np.where(inside, np.where(inside, scaled, 0).astype(np.int64), np.where(scaled > 0, LONG, -LONG))


def _exact(width: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if squared distances fit a long, else as Python integers."""
    most = max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)
    return list(arrays) if width * (2 * most) ** 2 < LONG else [a.astype(object) for a in arrays]


def _squares(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    apart = points - one
    return (apart * apart).sum(axis=-1)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, two steps of rounding outwards."""
    roots = np.sqrt(squares.astype(np.float64))
    for _ in range(2):
        roots = np.nextafter(roots, np.inf if up else 0.0)
    return roots


class Tree:
    """A vantage-point tree over the rows of ``entries``."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._built(np.arange(len(entries)))

    def _built(self, of: np.ndarray):
        if len(of) <= LEAF:
            return of
        squares = _squares(self.entries[of[1:]], self.entries[of[0]])
        order = np.argsort(squares, kind="stable")
        halves = np.array_split(order, 2)
        shells = [(float(_root(squares[h[:1]], False)[0]), float(_root(squares[h[-1:]], True)[0])) for h in halves]
        return of[0], [(near, far, self._built(of[1:][h])) for (near, far), h in zip(shells, halves, strict=True)]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each point."""
        index = np.zeros(len(points), np.int64)
        least = _squares(points, self.entries[0])
        self._search(self.top, points, np.arange(len(points)), index, least)
        return index, least

    def _better(self, entry: int, at: np.ndarray, squares: np.ndarray, index: np.ndarray, least: np.ndarray) -> None:
        held = least[at]
        wins = ((squares < held) | ((squares == held) & (entry < index[at]))).astype(bool)
        index[at[wins]], least[at[wins]] = entry, squares[wins]

    def _search(self, node, points: np.ndarray, at: np.ndarray, index: np.ndarray, least: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self._better(int(entry), at, _squares(points[at], self.entries[entry]), index, least)
            return
        entry, shells = node
        squares = _squares(points[at], self.entries[entry])
        self._better(int(entry), at, squares, index, least)
        low, high = _root(squares, False), _root(squares, True)
        bounds = [np.nextafter(np.maximum(np.maximum(low - far, near - high), 0.0), 0.0) for near, far, _ in shells]
        first = bounds[1] < bounds[0]
        # the likelier shell of each point, then the other one as far as it can still hold a nearest entry
        for turn in (0, 1):
            for side, (_, _, below) in enumerate(shells):
                mine = first if (side == 1) == (turn == 0) else ~first
                go = mine & (bounds[side] <= _root(least[at], True))
                self._search(below, points, at[go], index, least)


def _parts(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    """(rows, parts, width) integers of an Arrow list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat, SCALE).reshape(len(column), parts, dim // parts)


class Books:
    """The codebooks of all part positions with their trees, built when first asked."""

    def __init__(self, books: np.ndarray):
        self.books, self.trees = books, {}

    def nearest(self, cut_up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances of the parts, (rows, parts) each."""
        cut_up, books = _exact(self.books.shape[2], cut_up, self.books)
        trees = self.trees.setdefault(books.dtype, []) or [Tree(book) for book in books]
        self.trees[books.dtype] = trees
        found = [tree.nearest(np.ascontiguousarray(cut_up[:, p])) for p, tree in enumerate(trees)]
        return np.stack([i for i, _ in found], 1), np.stack([s for _, s in found], 1)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the codebooks after every part went to its nearest entry."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), object)
        n = np.zeros((parts, entries), np.int64)
        search = Books(books)
        for batch in batches:
            cut_up = _parts(batch.column(0), parts * width, parts)
            index, _ = search.nearest(cut_up)
            (exact,) = _exact(len(cut_up), cut_up)
            for p in range(parts):
                some = np.zeros((entries, width), exact.dtype)
                np.add.at(some, index[:, p], exact[:, p])
                total[p] += some
                n[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        cells = [pa.array([Decimal(int(v)) for v in total[part, entry, i]], pa.decimal128(38, 0)) for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry], pa.int64()), *cells], names=["part", "entry", "n", *(f"s{i}" for i in range(width))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width))
    # at most one row for each entry and position
    whole = rows.select("v").mapInArrow(sums, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for row in whole.collect():
        out[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return out


def _first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks of the vectors of least id; None if no row has an id."""
    named = rows.where(F.col("id").isNotNull()).withColumn("_size", F.size("v"))
    least = named.where(F.col("_size") % parts == 0).orderBy("id", "v").select("_size").head()
    if least is None:
        return None
    seeds = named.where(F.col("_size") == least[0]).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    return np.ascontiguousarray(integers(np.array([s["v"] for s in seeds], np.float64), SCALE).reshape(len(seeds), parts, -1).transpose(1, 0, 2))


def compressed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of each vector."""
    small_batches(vectors.sparkSession)
    rows = vectors.where(finite(F.col(column))).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(column).alias("v"))
    books = _first_books(rows, parts, entries)
    if books is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return rows.select("id", "label", *none)
    dim = parts * books.shape[2]
    rows = rows.where(F.size("v") == dim)
    for _ in range(rounds):
        books = _moved(rows, books)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Books(books)
        for batch in batches:
            index, squares = search.nearest(_parts(batch.column("v"), dim, parts))
            errors = [int(e) for e in squares.sum(1)]
            codes = [bytes(row).hex() if entries <= 256 else "".join(f"{i:08x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array([e if e <= LONG else None for e in errors], pa.int64())], names=["id", "label", "code", "error"])

    kind = dict(rows.dtypes)
    done = cut(rows.mapInArrow(coded, f"id {kind['id']}, label {kind['label']}, code string, error long"))
    # a null label is a label like others
    done = done.withColumn("_label", F.struct("label"))
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    sums = done.groupBy("_label").agg(F.count("*").alias("n"), total.alias("label_error"))
    out = joined_by_share(done, sums, ["_label"])
    return out.select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_codes(spark, sf_dir: str) -> DataFrame:
    found = compressed(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """Rounds written out: all distances, the least by index, floors of means."""
    part = "list_slice(x, 16 * p + 1, 16 * p + 16)"
    out = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * c) AS BIGINT)) AS x FROM embeddings
      WHERE len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding) AND len(embedding) > 0),
    v AS (SELECT vec_id, label, p, {part} AS x FROM k, (SELECT unnest(range(0, 4)) AS p)),
    b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"""
    for n in range(ROUNDS + 1):
        out += f""",
    a{n} AS MATERIALIZED (SELECT v.vec_id, v.label, v.p, v.x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
      SELECT v.vec_id, v.label, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN b{n} b ON v.p = b.p) v GROUP BY ALL)"""
        if n < ROUNDS:
            out += f""",
    s{n} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, unnest(range(0, 16)) AS i FROM a{n}) GROUP BY ALL),
    m{n} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY ALL),
    b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e)"""
    return (
        out
        + f""",
    r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY ALL)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM r"""
    )


OP11_SQL = _sql()
