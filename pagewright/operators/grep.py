"""Search in paginated documents: literal, regex, scoped, many patterns, quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as X
from .anchors import containing, kept
from .pages import QUERY_MARKER, page_map


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines that can match: not empty, no marker, within a page."""
    each = pages.select("doc_id", "physical_page", "printed_page", F.explode("lines").alias("x"))
    return each.select("doc_id", "physical_page", "printed_page", F.col("x.line").alias("line"), F.col("x.text").alias("text")).where((F.col("text") != "") & ~(F.startswith("text", F.lit("{")) & F.col("text").rlike(QUERY_MARKER)))


def matched_lines(pages: DataFrame) -> DataFrame:
    """The same lines as an array ``_lines`` of their page."""
    own = F.filter("lines", lambda x: (x["text"] != "") & ~(F.startswith(x["text"], F.lit("{")) & x["text"].rlike(QUERY_MARKER)))
    return pages.select("doc_id", "physical_page", "printed_page", own.alias("_lines"))


def _capped(matches: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The first lines of each key; at least one and at most the cap (F1)."""
    most = max(1, min(limit, SETTINGS.grep_limit))
    return matches.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("line"))).where(F.col("_n") <= most).drop("_n")


def grep(pages: DataFrame, pattern: str, pages_filter: Sequence[int] | None = None, regex: bool = False, limit: int = SETTINGS.grep_limit) -> DataFrame:
    """doc_id, printed_page, physical_page, line, snippet of the first matching
    lines of each document (J1, B1-B7, C3-C5). A filter of printed pages means
    the first page of each number; unknown numbers are ignored, only unknown ones
    give no match, and none or an empty filter means all pages."""
    wanted = X.regex_pattern(pattern) if regex else X.literal_pattern(pattern)
    lines = page_lines(pages)
    if pages_filter:
        chosen = page_map(pages).where(F.col("printed_page").isin(*pages_filter)).select("doc_id", "physical_page")
        lines = lines.join(chosen, ["doc_id", "physical_page"], "left_semi")
    return matching(lines, wanted, limit)


def matching(lines: DataFrame, wanted: str, limit: int | None) -> DataFrame:
    """The lines that match, with their snippets; the first of each document, or
    all if there is no limit."""
    found = lines.where(F.col("text").rlike(wanted))
    if limit is not None:
        found = _capped(found, ["doc_id"], limit)
    return found.select("doc_id", "printed_page", "physical_page", "line", X.snippet("text", wanted, SETTINGS.snippet_chars).alias("snippet"))


def worker_filter(asked: Sequence[int] | None, hint: Sequence[int] | None) -> Sequence[int] | None:
    """A worker's filter: none means the hint it was sent with, an empty one the
    whole document (B5)."""
    return hint if asked is None else asked or None


def grep_sections(pages: DataFrame, sections: DataFrame, pattern: str, regex: bool = False, limit: int = SETTINGS.grep_limit) -> DataFrame:
    """The same within sections (doc_id, section_name, pages); sections without
    pages match nothing (B6, C9)."""
    wanted = X.regex_pattern(pattern) if regex else X.literal_pattern(pattern)
    scope = sections.select("doc_id", "section_name", F.explode("pages").alias("printed_page")).distinct().join(page_map(pages), ["doc_id", "printed_page"])
    # the size of exploded lines is misjudged, so neither side is broadcast
    scope = scope.select("doc_id", "section_name", "physical_page").distinct().hint("merge")
    lines = page_lines(pages).where(F.col("text").rlike(wanted)).join(scope, ["doc_id", "physical_page"])
    found = _capped(lines, ["doc_id", "section_name"], limit)
    return found.select("doc_id", "section_name", "printed_page", "physical_page", "line", X.snippet("text", wanted, SETTINGS.snippet_chars).alias("snippet"))


def grep_many(pages: DataFrame, patterns: DataFrame, limit: int = SETTINGS.grep_limit) -> DataFrame:
    """(pattern_id, doc_id, printed_page, physical_page, line) of literal patterns
    (pattern_id, pattern), as an equi-join; there is no bound on their number."""
    found = containing(kept(pages), patterns.select("pattern_id", F.lower("pattern").alias("_low")))
    return _capped(found, ["pattern_id", "doc_id"], limit).select("pattern_id", "doc_id", "printed_page", "physical_page", "line")


def verify_quotes(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes (quote_id, doc_id, printed_page, quote) with status ``found`` (on
    the page named), ``other page`` or ``absent``, and the pages that have it in
    order (J15). A quote is looked for within one line, letter case aside; only
    documents that are quoted are read, by an equi-join on document and key."""
    asked = quotes.select("quote_id", "doc_id", F.col("printed_page").alias("_asked"), F.lower("quote").alias("_low"))
    cited = kept(pages.join(asked.select("doc_id").distinct(), "doc_id", "left_semi"))
    hits = containing(cited, asked, scoped=True).groupBy("quote_id", "doc_id", "_asked", F.col("printed_page").alias("_p"), "physical_page").agg(F.lit(1).alias("_one"))
    first = page_map(cited).select("doc_id", F.col("printed_page").alias("_asked"), F.col("physical_page").alias("_first"))
    hits = hits.join(first, ["doc_id", "_asked"], "left")
    seen = hits.groupBy("quote_id").agg(F.bool_or(F.coalesce(F.col("physical_page") == F.col("_first"), F.lit(False))).alias("_here"), F.array_sort(F.collect_set("_p")).alias("pages"))
    status = F.when(F.col("_here"), "found").when(F.col("_here").isNotNull(), "other page").otherwise("absent")
    return quotes.join(seen, "quote_id", "left").select("quote_id", "doc_id", "printed_page", status.alias("status"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))
