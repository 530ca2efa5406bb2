"""Lines that hold one of many texts: an equi-join on each text's rarest gram.

The grams of the lines are counted once.  Of each wanted text the rarest gram is
its anchor; a line can hold the text only if it holds the anchor.  A Bloom filter
of the anchors (with the document, where a text is wanted in one document only)
has a fixed size and goes to every task: it decides on the line side, before
anything is exploded, which lines and grams can meet an anchor at all.  What is
joined is (gram, line name); the texts of the lines that passed stay in a table
of their own and meet the pairs by line name, and ``contains`` decides.

A text shorter than a gram is its own gram, and lines then have grams of its
size too.  There is no bound on the number of texts, and none is left out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grams as G
from ..lineage import cut
from .pages import QUERY_MARKER

#: bits of the filter of anchors, a power of two, and how many each sets
BITS = 1 << 24
HASHES = 3
#: grams whose counts are broadcast, 16 bytes each
COUNTED = 1 << 20
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _bits(grams: np.ndarray, scope: np.ndarray) -> Iterator[np.ndarray]:
    """Places of a key's bits."""
    key = grams.astype(np.uint64) ^ (scope.astype(np.uint64) * np.uint64(_FACTORS[0]))
    key = (key ^ (key >> np.uint64(31))) * np.uint64(_FACTORS[1])
    key ^= key >> np.uint64(29)
    for factor in _FACTORS[:HASHES]:
        yield ((key * np.uint64(factor)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _lines(pages: DataFrame, scoped: bool) -> DataFrame:
    """A page's lines that can match, in lower case, as arrays within its row."""
    own = F.filter("lines", lambda x: (x["text"] != "") & ~(F.startswith(x["text"], F.lit("{")) & x["text"].rlike(QUERY_MARKER)))
    scope = F.xxhash64("doc_id") if scoped else F.lit(0).cast("long")
    rows = pages.select("doc_id", "printed_page", "physical_page", scope.alias("_scope"), own.alias("_x"))
    return rows.select("doc_id", "printed_page", "physical_page", "_scope", F.transform("_x", lambda x: x["line"]).alias("_n"), F.transform("_x", lambda x: F.lower(x["text"])).alias("_t"))


def _with_grams(wanted: DataFrame) -> DataFrame:
    """``wanted`` with the distinct grams of ``_low`` as ``_grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_low")
            found = list(G.of_lines(texts))
            short = [(i, g) for i, t in enumerate(texts.to_pylist()) if len(t) < G.SIZE for g in G.of_text(t, len(t))]
            grams = np.concatenate([g for g, _ in found] + [np.array([g for _, g in short], np.int64)])
            owner = np.concatenate([o for _, o in found] + [np.array([i for i, _ in short], np.int64)])
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            first = (np.diff(owner, prepend=-1) != 0) | (np.diff(grams, prepend=0) != 0)
            ends = np.searchsorted(owner[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[first]))], names=[*batch.schema.names, "_grams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return wanted.mapInArrow(run, f"{kinds}, _grams array<long>")


def gram_counts(lines: DataFrame, sizes: Sequence[int] = (G.SIZE,)) -> DataFrame:
    """(gram, n): how often each gram occurs in ``_t``; counted in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, _ in G.of_lines(batch.column("_t").flatten(), tuple(sizes)):
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return lines.select("_t").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _filter_of(anchors: DataFrame) -> np.ndarray:
    """The Bloom filter as 64-bit words; at most BITS / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.concatenate(list(_bits(batch.column("_gram").to_numpy(), batch.column("_scope").to_numpy()))))
            words, bits = places >> 6, np.left_shift(np.int64(1), places & 63)
            starts = np.flatnonzero(np.diff(words, prepend=-1))
            if len(starts):
                yield pa.RecordBatch.from_arrays([pa.array(words[starts]), pa.array(np.bitwise_or.reduceat(bits, starts))], names=["word", "bits"])

    out = np.zeros(BITS // 64, np.int64)
    for row in anchors.select("_gram", "_scope").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def _passing(lines: DataFrame, bloom: np.ndarray, sizes: Sequence[int]) -> DataFrame:
    """Lines with a gram that may be an anchor, and their grams of that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_t")
            page = np.repeat(np.arange(batch.num_rows), np.diff(texts.offsets.to_numpy()))
            flat, numbers, scope = texts.flatten(), batch.column("_n").flatten(), batch.column("_scope").to_numpy()
            for grams, line in G.of_lines(flat, tuple(sizes)):
                keep = np.ones(len(grams), bool)
                for places in _bits(grams, scope[page[line]]):
                    keep[keep] = (bloom[places[keep] >> 6] >> (places[keep] & 63)) & 1 == 1
                if not keep.any():
                    continue
                grams, line = grams[keep], line[keep]
                order = np.lexsort((grams, line))
                grams, line = grams[order], line[order]
                first = (np.diff(line, prepend=-1) != 0) | (np.diff(grams, prepend=0) != 0)
                grams, line = grams[first], line[first]
                starts = np.flatnonzero(np.diff(line, prepend=-1))
                rows, at = line[starts], pa.array(page[line[starts]])
                ends = pa.array(np.append(starts, len(grams)).astype(np.int32))
                cells = [*(batch.column(c).take(at) for c in ("doc_id", "printed_page", "physical_page")), numbers.take(pa.array(rows)), flat.take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(grams))]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "printed_page", "physical_page", "line", "_l", "_grams"])

    kinds = dict(lines.dtypes)
    schema = f"doc_id {kinds['doc_id']}, printed_page int, physical_page int, line int, _l string, _grams array<long>"
    return lines.mapInArrow(run, schema)


def kept(pages: DataFrame) -> DataFrame:
    """What a search needs of the pages, split once and written."""
    return cut(pages.select("doc_id", "printed_page", "physical_page", "lines"))


def containing(pages: DataFrame, wanted: DataFrame, scoped: bool = False) -> DataFrame:
    """The columns of ``wanted``, with the place (doc_id, printed_page,
    physical_page, line) of each line that holds ``_low``, letter case aside;
    ``scoped`` texts are looked for in the document ``doc_id`` they name.

    The pages are read twice, to count grams and to find lines, so they should be
    kept ones. A null or empty text is held by no line; equal texts are found each; texts
    for which nothing is there, and empty tables, give no row."""
    asked = wanted.where("_low is not null and _low <> ''").withColumn("_scope", F.xxhash64("doc_id") if scoped else F.lit(0).cast("long"))
    lines = _lines(pages, scoped)
    if scoped:
        lines = lines.where("doc_id is not null")
    # at most two rows: texts of one and of two characters
    short = {r[0] for r in asked.select(F.length("_low").alias("n")).where(F.col("n") < G.SIZE).distinct().collect()}
    sizes = (G.SIZE, *sorted(short))
    keyed = cut(_with_grams(asked.withColumn("_id", F.monotonically_increasing_id())))
    needed = keyed.select(F.explode("_grams").alias("gram")).distinct()
    counts = cut(gram_counts(lines, sizes).join(needed, "gram", "left_semi"))
    if counts.count() <= COUNTED:
        counts = F.broadcast(counts)
    # a text with a gram that no line has is nowhere
    each = keyed.select("_id", F.explode("_grams").alias("gram")).join(counts, "gram", "left")
    anchor = each.groupBy("_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("_gram"), F.bool_and(F.col("n").isNotNull()).alias("_all")).where("_all").drop("_all")
    anchored = cut(keyed.drop("_grams").join(anchor, "_id"))
    passing = cut(_passing(lines, _filter_of(anchored), sizes).withColumn("_at", F.monotonically_increasing_id()))
    on = ["_gram", "doc_id"] if scoped else ["_gram"]
    named = [c for c in wanted.columns if c != "doc_id"]
    # the wanted text goes to its lines, and is looked for there: no line's text is repeated for each text it may hold
    met = passing.select("_at", *on[1:], F.explode("_grams").alias("_gram")).join(anchored.select(*named, *on), on).select(*named, "_at")
    texts = passing.drop("_grams").hint("merge")
    found = met.join(texts, "_at").where(F.contains("_l", F.col("_low")))
    return found.select(*named, "doc_id", "printed_page", "physical_page", "line")
