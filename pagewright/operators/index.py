"""A search index that is kept: pages in segments, and postings of character grams.

*Build.* Each task's pages are one segment, a Parquet partition; nothing is
shuffled for that, and a document may lie in several segments. For every gram of
three characters (without regard to case) a segment has one list of the lines
that hold it, as gaps between (page row, line) numbers. Lists are dealt to
``BUCKETS`` partitions by gram and sorted by it, so a query reads the row groups
of its own grams only. More documents are more segments; nothing is rewritten.

*Search.* A pattern becomes a tree: which grams must be there, all of some or one
of others. In each segment the lists are met shortest first. What is left is
verified on the lines themselves by the pattern; pages of segments without a
candidate are not read. A pattern that needs no gram (too short, or of unbounded
choice) is matched on all kept pages, exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions import text as X
from ..functions.needs import Need, grams_in, literal_need, regex_need
from ..lineage import cut
from . import grep
from .pages import page_map

#: partitions of the lists by gram (61 is prime, so all are used alike)
BUCKETS = 61
#: tasks that write one bucket of a large build
SALT = 16
#: (line, gram) pairs that a task holds before it writes lists
HELD = 1 << 22
#: lines within a page, as a power of two
LINE_BITS = 30
#: candidate lines that are broadcast; more meet their pages by key
BROADCAST = 1 << 20


def add(pages: DataFrame, path: str) -> None:
    """Put pages (of ``pages.doc_pages``) into the index at ``path``, which is made
    if it isn't there. Pages without lines are kept; null ids stay null."""
    stamp, spark = uuid.uuid4().hex[:16], pages.sparkSession
    kept = pages.select("doc_id", "physical_page", "printed_page", "start_line", "end_line", "page_lines", F.when(~F.col("lines").eqNullSafe(F.col("page_lines")), F.col("lines")).alias("_own"))
    named = kept.withColumn("segment", F.concat(F.lit(f"{stamp}-"), F.spark_partition_id().cast("string")))
    named = named.withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    named.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    named.write.partitionBy("segment").mode("append").option("compression", "zstd").parquet(f"{path}/pages")
    fresh = _stored(spark, path).where(F.startswith("segment", F.lit(stamp)))
    rows = fresh.select("segment", "row", F.transform("lines", lambda x: x["text"]).alias("texts"))
    lists = rows.mapInArrow(_lists, LISTS)
    lists = lists.withColumn("bucket", F.pmod("gram", F.lit(BUCKETS)).cast("int"))
    dealt = lists.repartition("bucket", F.pmod(F.xxhash64("segment"), F.lit(SALT))).sortWithinPartitions("bucket", "gram", "segment")
    dealt.write.partitionBy("bucket").mode("append").option("compression", "zstd").parquet(f"{path}/postings")


LISTS = "segment string, gram long, gaps array<long>"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list for each gram of each segment, or several if there is much of it."""

    def lists(segment: str, grams: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        gram, code = np.concatenate(grams), np.concatenate(codes)
        order = np.argsort(gram, kind="stable")
        gram, code = gram[order], code[order]
        fresh = np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(code) != 0)])
        gram, code = gram[fresh], code[fresh]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(gram) != 0]))
        gaps = np.diff(code, prepend=0)
        gaps[starts] = code[starts]
        ends = pa.array(np.append(starts, len(gram)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([segment] * len(starts), pa.string()), pa.array(gram[starts]), pa.ListArray.from_arrays(ends, pa.array(gaps))], names=["segment", "gram", "gaps"])

    last, grams, codes, held = None, [], [], 0
    for batch in batches:
        texts, segments, numbers = batch.column("texts"), batch.column("segment").to_pylist(), batch.column("row").to_numpy()
        ends = texts.offsets.to_numpy()
        edges = [i for i in range(batch.num_rows) if not i or segments[i] != segments[i - 1]] + [batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if segments[a] != last and held:
                yield lists(last, grams, codes)
                grams, codes, held = [], [], 0
            last = segments[a]
            some = texts.slice(a, b - a)
            page = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))
            line = np.arange(len(page)) - (ends[page] - ends[a])
            for gram, at in G.of_lines(some.flatten(), fold=True):
                grams.append(gram)
                codes.append(numbers[page[at]] << LINE_BITS | line[at])
                held += len(gram)
                if held >= HELD:
                    yield lists(last, grams, codes)
                    grams, codes, held = [], [], 0
    if held:
        yield lists(last, grams, codes)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    # an index of no page has no file to take the columns from
    rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/pages")
    return rows.withColumn("lines", F.coalesce("_own", "page_lines")).drop("_own")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """The kept pages, with the columns of ``pages.doc_pages``: what reads pages
    needs no second split of the documents (A8)."""
    return _stored(spark, path).select("doc_id", "physical_page", "start_line", "end_line", "page_lines", "lines", "printed_page")


def candidates(spark: SparkSession, path: str, need: Need) -> DataFrame:
    """(segment, row, at): the lines of each page row that hold what is needed."""
    wanted = sorted(grams_in(need))
    lists = spark.read.schema(f"{LISTS}, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({g % BUCKETS for g in wanted})) & F.col("gram").isin(wanted))
    held = lists.groupBy("segment").agg(F.collect_list(F.struct("gram", "gaps")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                each = batch.column("held").slice(i, 1).flatten()
                gaps, grams = each.field("gaps"), each.field("gram").to_pylist()
                codes: dict[int, list[np.ndarray]] = {}
                for k, gram in enumerate(grams):
                    codes.setdefault(gram, []).append(np.cumsum(gaps.slice(k, 1).flatten().to_numpy()))
                found = need.met({g: np.unique(np.concatenate(c)) for g, c in codes.items()})
                if not len(found):
                    continue
                row = found >> LINE_BITS
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                ends = pa.array(np.append(starts, len(found)).astype(np.int32))
                at = pa.ListArray.from_arrays(ends, pa.array((found & ((1 << LINE_BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("segment")[i].as_py()] * len(starts), pa.string()), pa.array(row[starts]), at], names=["segment", "row", "at"])

    return held.mapInArrow(run, "segment string, row long, at array<int>")


def grep_indexed(spark: SparkSession, path: str, pattern: str, pages_filter: Sequence[int] | None = None, regex: bool = False, limit: int | None = None) -> DataFrame:
    """The same as ``grep.grep`` on the pages of the index; without ``limit`` all
    matching lines. An empty index has no match."""
    wanted = X.regex_pattern(pattern) if regex else X.literal_pattern(pattern)
    need = regex_need(pattern) if regex else literal_need(pattern)
    if need is None:
        lines = grep.page_lines(pages(spark, path))
    else:
        found = cut(candidates(spark, path, need))
        n = found.agg(F.sum(F.size("at"))).first()[0] or 0
        # the condition tells the optimizer that this side is worth a pruning of segments
        found = found.where(F.size("at") > 0)
        rows = _stored(spark, path).join(F.broadcast(found) if n <= BROADCAST else found.hint("merge"), ["segment", "row"])
        lines = grep.page_lines(rows.withColumn("lines", F.transform("at", lambda i: F.get(F.col("lines"), i))))
    if pages_filter:
        chosen = page_map(pages(spark, path)).where(F.col("printed_page").isin(*pages_filter)).select("doc_id", "physical_page")
        lines = lines.join(chosen, ["doc_id", "physical_page"], "left_semi")
    return grep.matching(lines, wanted, limit)
