"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most e edits shares at
least m - q + 1 - q e of its q-grams with the place, all on nearby diagonals
(text position minus item position).  The filter works in three steps:

1. a table of the items' q-gram hashes marks each text position whose q-gram
   some item has; only windows that hold enough marks for an item go on;
2. the marks that are left are looked up in the items' postings, and shared
   q-grams are counted for each item in diagonal bands of twice the budget that
   overlap by half, so every place lies whole in some band;
3. bands that reach the bound of the lemma are verified by an alignment of the
   item with the region of the band, free at both ends of the region, and its
   ends and edits are reported.

The comparison is of lower-cased characters.  The edit budget is ``RATE`` of
the item's length, less where the lemma would else give no bound.  Items are
broadcast in chunks of a measured size, one at a time, as many passes as that
takes.

Defined cases: null text or item is empty; empty items match nothing; items
shorter than q characters are found as exact text; texts are taken whole;
repeated rows of either table are reported each (equal items under each id);
rows of null id are matched and reported with null; empty tables give no row;
other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import cut, pieces, small_batches, table, texts

Q = 8
RATE = 0.08
CHUNK_CHARS = 4_000_000
#: pairs of text places and item postings that are held at a time
SLICE = 1 << 20


def lowered(text: str) -> str:
    """Lower case, place by place; characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def codes(text: str) -> np.ndarray:
    """Lower-cased code points."""
    return np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(values: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of every q-gram."""
    if len(values) < q:
        return np.zeros(0, np.uint32)
    powers, done = {1: values * np.uint32(0x9E3779B1)}, 1
    while done * 2 <= q:
        half = powers[done]
        powers[done * 2] = (half[:-done] * np.uint32(0x85EBCA6B) ^ half[:-done] >> np.uint32(15)) + half[done:]
        done *= 2
    out, size = powers[done], done
    for bit in sorted(powers, reverse=True):
        while size + bit <= q:
            tail = powers[bit]
            n = len(tail) - size
            out = (out[:n] * np.uint32(0xC2B2AE35) ^ out[:n] >> np.uint32(13)) + tail[size:]
            size += bit
    return out * np.uint32(0x27D4EB2F)


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Fewest edits between ``item`` and a part of ``region``, and that part's end."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (region != c)]))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """The items of one chunk, made ready for search."""

    def __init__(self, rows: list[tuple[int | None, str]], q: int = Q, rate: float = RATE):
        self.q = q
        self.ids, self.short = [], []
        self.codes, self.edits, self.least = [], [], []
        for key, text in rows:
            values = codes(text)
            if not len(values):
                continue
            if len(values) < q:
                self.short.append((key, lowered(text)))
                continue
            e = max(0, min(int(rate * len(values)), (len(values) - q) // q))
            self.ids.append(key)
            self.codes.append(values)
            self.edits.append(e)
            self.least.append(len(values) - q + 1 - q * e)
        found = [grams(c, q) for c in self.codes]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found]) if found else owner
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner, self.place = flat[order], owner[order], place[order]
        self.bits = 22
        self.marked = np.zeros(1 << self.bits, bool)
        self.marked[flat >> np.uint32(32 - self.bits)] = True
        # items of about one length share a window of the first filter
        self.windows: dict[int, tuple[int, int]] = {}
        for c, e, least in zip(self.codes, self.edits, self.least, strict=True):
            group = int(np.log(len(c)) / np.log(1.2))
            width, need = self.windows.get(group, (0, 1 << 60))
            self.windows[group] = (max(width, len(c) + e), min(need, least))
        self.edits, self.least = np.array(self.edits, np.int64), np.array(self.least, np.int64)

    def _hopeful(self, marks: np.ndarray) -> np.ndarray:
        """Marks that lie in a window with enough of them."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        inside = np.zeros(len(marks) + 1, np.int32)
        n = len(marks)
        for width, need in self.windows.values():
            width = min(width, n)
            good = np.flatnonzero(total[width:] - total[:-width] >= need)
            if len(good):
                # starts and ends of unions of good windows
                gap = np.flatnonzero(np.diff(good) > width)
                np.add.at(inside, good[np.concatenate([[0], gap + 1])], 1)
                np.add.at(inside, good[np.concatenate([gap, [len(good) - 1]])] + width, -1)
        return marks & (np.cumsum(inside[:-1]) > 0)

    def search(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item, start, end, edits) of every place; of places of one item that
        overlap, the one with the fewest edits."""
        low = lowered(text) if self.short else ""
        out = [(key, at, at + len(s), 0) for key, s in self.short for at in _all(low, s)]
        if not self.codes or len(text) < self.q:
            return out
        values = codes(text)
        hashes = grams(values, self.q)
        marks = self.marked[hashes >> np.uint32(32 - self.bits)]
        at = np.flatnonzero(self._hopeful(marks))
        if not len(at):
            return out
        best: dict[int, list[tuple[int, int, int]]] = {}
        for i, b in self._bands(hashes, at):
            e, want = int(self.edits[i]), self.codes[i]
            start = max(0, b * (e + 1) - e)
            stop = min(len(values), (b + 2) * (e + 1) + len(want) + e)
            region = values[start:stop]
            if (exact := _first(region, want)) >= 0:
                best.setdefault(i, []).append((0, start + exact, start + exact + len(want)))
                continue
            edits, end = align(want, region)
            if edits <= e:
                _, length = align(want[::-1], values[start : start + end][::-1])
                best.setdefault(i, []).append((edits, start + end - length, start + end))
        for i, places in best.items():
            out += [(self.ids[i], s, t, n) for s, t, n in _apart(places)]
        return out

    def _bands(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) of every diagonal band with enough shared q-grams. The
        pairs of places and postings are counted slice by slice, so their number
        bounds the time but not the memory, however repetitive both sides are."""
        low, high = (self.hashes.searchsorted(hashes[at], side) for side in ("left", "right"))
        count = high - low
        seen, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(count)
        begin = 0
        while begin < len(at):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + SLICE, "right")))
            first, size = low[begin:stop], count[begin:stop]
            rows = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            item = self.owner[rows]
            # floor; each hit counts in its band and the one before
            band = (np.repeat(at[begin:stop], size) - self.place[rows]) // (self.edits[item] + 1)
            keys, n = np.unique((item << 40) + band + (1 << 39), return_counts=True)
            if len(seen):
                keys, back = np.unique(np.concatenate([seen, keys]), return_inverse=True)
                n = np.bincount(back, np.concatenate([held, n])).astype(np.int64)
            seen, held, begin = keys, n, stop
        # a band takes the hits of two neighbouring strips of diagonals
        keys = np.unique(np.concatenate([seen, seen - 1]))
        total = np.zeros(len(keys), np.int64)
        for strip in (keys, keys + 1):
            if len(seen):
                place = np.minimum(np.searchsorted(seen, strip), len(seen) - 1)
                total += np.where(seen[place] == strip, held[place], 0)
        item = keys >> 40
        good = total >= self.least[item]
        return list(zip(item[good].tolist(), ((keys & (1 << 40) - 1) - (1 << 39))[good].tolist(), strict=True))


def _first(region: np.ndarray, item: np.ndarray) -> int:
    """The first place of an exact occurrence, or -1."""
    data, want, at = region.tobytes(), item.tobytes(), -1
    while (at := data.find(want, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def _apart(places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, edits) in order: of places (edits, start, end) that overlap,
    the one with the fewest edits, then the first."""
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for edits, start, end in sorted(set(places)):
        n = bisect.bisect_left(starts, start)
        if (n == 0 or taken[n - 1][1] <= start) and (n == len(starts) or end <= starts[n]):
            starts.insert(n, start)
            taken.insert(n, (start, end, edits))
    return taken


def _all(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


def _chunks(items: DataFrame, item: str, item_text: str, chunk: int) -> list[DataFrame]:
    """The distinct items with their number of rows (i, t, n), in parts that are
    measured: none holds more than ``chunk`` characters, save for one item that
    is longer by itself."""
    items = items.select(F.col(item).alias("i"), F.coalesce(item_text, F.lit("")).alias("t")).groupBy("i", "t").agg(F.count("*").alias("n"))
    part = lambda parts: F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    parts, most = 1, None
    while most is None or most > chunk:
        if most is not None:
            parts *= 2
        sizes = items.groupBy(part(parts)).agg(F.sum(F.length("t")).alias("held"), F.count("*").alias("rows"))
        most = sizes.where("rows > 1").agg(F.max("held")).first()[0] or 0
    return [items.where(part(parts) == p) for p in range(parts)]


def _shared_items(part: DataFrame):
    """One part of the distinct items with their number of rows, as a broadcast."""
    rows = [tuple(r) for r in part.collect()]
    return part.sparkSession.sparkContext.broadcast(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])))


def _passes(parts: list[DataFrame], one: Callable[..., DataFrame]) -> Iterator[DataFrame]:
    """``one`` with each part's broadcast; all but the last are run at once and
    their broadcast is dropped, so that one part at a time is held."""
    for n, part in enumerate(parts):
        shared = _shared_items(part)
        found = one(shared)
        if n < len(parts) - 1:
            found = cut(found)
            shared.destroy()
        yield found


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", item: str = "item_id", item_text: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """(key, item, start, end, edits) of every place of an item in a text, in
    code points, ends exclusive."""
    small_batches(docs.sparkSession)
    docs = docs.select(key, column)
    schema = T.StructType([docs.schema[key], T.StructField(item, items.schema[item].dataType), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "edits"))])
    ids = to_arrow_type(items.schema[item].dataType)

    def one(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            ready = Items([(k, t) for k, (_, t, _) in enumerate(rows)])
            for batch in pieces(batches):
                found = [(n, *f) for n, t in enumerate(texts(batch.column(1))) for f in ready.search(t)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                keys = batch.column(0).take(pa.array(columns[0], pa.int64()))
                rest = [pa.array([rows[k][0] for k in columns[1]], ids)] + [pa.array(c, pa.int32()) for c in columns[2:]]
                rest.append(pa.array([rows[k][2] for k in columns[1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *rest], names=[key, item, "start", "end", "edits", "_times"])

        # an item of several rows is found as often, but searched for once
        found = docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("_times", T.LongType())]))
        return found.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")

    return reduce(DataFrame.unionByName, _passes(_chunks(items, item, item_text, chunk), one))


def without_leaks(docs: DataFrame, items: DataFrame, column: str = "text", item: str = "item_id", item_text: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, whatever their ids; nothing
    is joined or shuffled."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(column)

    def one(docs: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Items([(i, t) for i, t, _ in shared.value])
            for batch in pieces(batches):
                yield batch.filter(pa.array([not ready.search(t) for t in texts(batch.column(place))], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    parts = _chunks(items, item, item_text, chunk)
    for n, part in enumerate(parts):
        shared = _shared_items(part)
        docs = one(docs, shared)
        if n < len(parts) - 1:
            docs = cut(docs)
            shared.destroy()
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
