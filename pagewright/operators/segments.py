"""Tables of contents, section scopes and segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SETTINGS
from ..functions import text as X
from .intervals import in_ranges
from .pages import printed_pages, strip_footer

SEPARATORS = ("\n\n", "\n", " ", "")


def toc_ranges(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """toc (doc_id, pos, section_name, chapter_name, page_number) to entries with
    toc_no, start_page, end_page. Entries without a number go; order is by page,
    then place; a section ends before the next one starts, never before its own
    start, and the last ends at the largest printed page (B8, D19, E2, E12)."""
    most = pages.groupBy("doc_id").agg(F.max("printed_page").alias("_most")).where("_most is not null")
    order = Window.partitionBy("doc_id").orderBy("page_number", "pos")
    numbered = toc.where("page_number is not null").withColumn("toc_no", F.row_number().over(order) - 1).withColumn("_next", F.lead("page_number").over(order))
    return numbered.join(most, "doc_id").select("doc_id", "toc_no", "section_name", "chapter_name", F.col("page_number").alias("start_page"), F.greatest("page_number", F.coalesce(F.col("_next") - 1, F.col("_most"))).alias("end_page"))


def section_pages(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, toc_no, section_name, chapter_name, printed_page, pos, text) for
    every page of a section in text order; an equi-join by bins, whatever numbers
    the contents hold (C1, C2, H25). ``pages`` is of the ingest grammar."""
    last = Window.partitionBy("doc_id", "page_number").orderBy(F.desc("pos"))
    shown = pages.withColumn("text", F.first("text").over(last))
    points = shown.where("printed_page is not null").select("doc_id", "printed_page", "pos", "text")
    return in_ranges(points, ranges, ["doc_id"], "printed_page", "start_page", "end_page")


def section_text(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections with text: doc_id, toc_no, names, pages (printed, ascending),
    text (pages without footers, a blank line between); sections without text
    are left out (B9, H8, H9)."""
    found = section_pages(ranges, pages).withColumn("_t", X.strip(strip_footer("text", "printed_page")))
    piece = F.struct("printed_page", "pos", "_t")
    out = found.groupBy("doc_id", "toc_no", "section_name", "chapter_name").agg(F.array_sort(F.collect_set("printed_page")).alias("pages"), F.array_sort(F.collect_list(F.when(F.col("_t") != "", piece))).alias("_p"))
    return out.withColumn("text", F.array_join(F.transform("_p", lambda x: x["_t"]), "\n\n")).drop("_p").where(F.length("text") > 0)


def _scoped(held: Column, shown: Callable[[Column], list[Column]]) -> Column:
    """The sections of the contents ``_toc`` over the printed pages ``held``, each
    with what ``shown`` makes of its pages (C1, C2, B8, E2, E12)."""
    most = F.array_max(F.transform(held, lambda p: p["printed"]))

    def one(e: Column, i: Column) -> Column:
        ends = F.greatest(e["page_number"], F.coalesce(F.get(F.col("_toc"), i + 1)["page_number"] - 1, most))
        inside = F.filter(held, lambda p: p["printed"].between(e["page_number"], ends))
        return X.once(inside, lambda x: F.struct(
            i.alias("toc_no"), e["section_name"].alias("section_name"), e["chapter_name"].alias("chapter_name"),
            F.array_distinct(F.transform(x, lambda p: p["printed"])).alias("pages"), *shown(x),
        ))

    return F.transform("_toc", one)


def _contents(toc: DataFrame) -> DataFrame:
    entry = F.struct("page_number", "pos", "section_name", "chapter_name")
    return toc.where("page_number is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("_toc")).hint("merge")


def sections(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """``section_text`` straight from documents: pages, footers and the scopes of
    a document's contents are arrays of its row, so only the contents are
    gathered and the texts meet them in one join (C1, C2, B8, B9, E2, E12), by key:
    texts are never broadcast."""
    joined = lambda x: [F.array_join(F.filter(F.transform(x, lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("text")]
    both = docs.select("doc_id", "text").join(_contents(toc), "doc_id")
    each = both.select("doc_id", F.explode(X.once(printed_pages("text"), lambda held: _scoped(held, joined))).alias("_s"))
    return each.select("doc_id", "_s.*").where(F.length("text") > 0)


def section_scopes(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """``sections`` without their text, for those who need the pages only: of a
    document its printed numbers meet the contents, and no text moves."""
    full = lambda x: [F.exists(x, lambda p: p["full"]).alias("full")]
    held = F.transform(printed_pages("text"), lambda p: F.struct(p["printed"].alias("printed"), (p["text"] != "").alias("full")))
    both = docs.select("doc_id", held.alias("_held")).join(_contents(toc), "doc_id")
    each = both.select("doc_id", F.explode(_scoped(F.col("_held"), full)).alias("_s"))
    return each.select("doc_id", "_s.*").where("full").drop("full")


def chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character chunking: split at the first separator that occurs,
    keeping it at the start of the next piece; join pieces up to ``size``; carry
    whole pieces of up to ``overlap`` over; split longer pieces further."""
    at = next((n for n, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        first, *rest = text.split(mark)
        pieces = [p for p in (first, *(mark + r for r in rest)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    for piece in pieces:
        if len(piece) >= size and mark:
            emit()
            held, total = [], 0
            out += chunks(piece, size, overlap, finer) if finer else [piece]
            continue
        if held and total + len(piece) > size:
            emit()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    emit()
    return out


def chunked(sections: DataFrame, size: int = SETTINGS.chunk_chars, overlap: int = SETTINGS.chunk_overlap, count=X.token_count) -> DataFrame:
    """Segments of sections: seg_no counts through the document (H10, E7, H14, J13);
    ``count`` gives the tokens of a text."""

    def run(frames):
        for frame in frames:
            frame["chunks"] = [chunks(t, size, overlap) for t in frame["text"]]
            frame["pages"] = [list(p) for p in frame["pages"]]
            yield frame.drop(columns=["text"])

    schema = sections.drop("text").schema.add("chunks", T.ArrayType(T.StringType()))
    each = sections.select(*sections.drop("text").columns, "text").mapInPandas(run, schema)
    return numbered(each.select("*", F.posexplode("chunks").alias("chunk_no", "text")).drop("chunks"), count)


def fixed_width(sections: DataFrame, size: int) -> DataFrame:
    """Segments of just ``size`` characters, without leaving the JVM."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    each = sections.withColumn("chunk_no", F.explode(starts)).withColumn("text", F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)))
    return numbered(each)


def numbered(segments: DataFrame, count=X.token_count) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("toc_no", "chunk_no")
    out = segments.withColumn("seg_no", F.row_number().over(order) - 1)
    return out.select("doc_id", "seg_no", X.segment_id("seg_no").alias("seg_id"), "section_name", "chapter_name", "pages", count("text").alias("token_count"), "text")


def segments(docs: DataFrame, toc: DataFrame, size: int = SETTINGS.chunk_chars, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """Documents and their tables of contents to segments (K1)."""
    return chunked(sections(docs, toc), size, overlap)


def analyzed(segments: DataFrame, topics: int = 5, quotes: int = 3) -> DataFrame:
    """A deterministic analysis of each segment (J11): cues for tables and
    figures, sentiment by cue words, figures with a unit as metrics, capitalised
    phrases as entities, sentences that warn as risks. The first ``topics`` long
    words are its topics and the first ``quotes`` sentences its quotes: a choice
    of the most telling, as the schema of an analysis asks for."""
    text = F.col("text")
    words = F.split(F.lower(text), r"[^\p{L}]+")
    good = F.size(F.filter(words, lambda w: w.isin("growth", "strong", "improved", "record", "gain", "success")))
    bad = F.size(F.filter(words, lambda w: w.isin("loss", "decline", "weak", "risk", "adverse", "failure")))
    sentiment = F.when((good > 0) & (bad > 0), "mixed").when(good > 0, "positive").when(bad > 0, "negative").otherwise("neutral")
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    number = r"(\d[\d,]*(?:\.\d+)?)\s*(%|percent|million|billion|crore|lakh)"
    metrics = F.transform(F.regexp_extract_all(text, F.lit(number), 0), lambda m: F.struct(F.lower(F.regexp_extract(m, number, 2)).alias("name"), m.alias("value_text"), _scaled(m, number).alias("numeric_value"), F.regexp_extract(m, number, 2).alias("unit"), F.lit(None).cast("string").alias("time_period"), F.lit("").alias("supporting_quote")))
    entities = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"), 0))
    risks = F.transform(F.filter(sentences, lambda s: F.lower(s).rlike(r"\brisks?\b|\badverse\b")), lambda s: F.struct(s.alias("text"), F.lit("general").alias("risk_category"), F.lit(None).cast("string").alias("severity")))
    return segments.select(
        "doc_id", "seg_no", "seg_id", "section_name", "chapter_name", "pages", "token_count",
        F.when(text.rlike(r"�"), "low").otherwise("high").alias("ocr_confidence"),
        text.rlike(r"(?m)^.*\S\s*\|\s*\S.*$").alias("has_table"),
        text.rlike(r"(?m)!\[.*\]\(|^Figure: ").alias("has_figure"),
        F.get(sentences, F.lit(0)).alias("summary"),
        F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 8)), 1, topics).alias("topics"),
        sentiment.alias("sentiment"),
        F.transform(entities, lambda e: F.struct(e.alias("name"), F.array().cast("array<string>").alias("aliases"))).alias("key_entities"),
        metrics.alias("metrics"),
        risks.alias("risks"),
        F.slice(sentences, 1, quotes).alias("salient_quotes"),
    )


def _scaled(match, pattern):
    """Amount times its unit word; percentages stay as they are."""
    value = F.regexp_replace(F.regexp_extract(match, pattern, 1), ",", "").cast("double")
    unit = F.regexp_extract(match, pattern, 2)
    factor = F.when(unit == "million", 1e6).when(unit == "billion", 1e9).when(unit == "crore", 1e7).when(unit == "lakh", 1e5).otherwise(1.0)
    return value * factor
