"""Pages of marked-up documents, in both grammars.

*Query* grammar (for search): a marker is a whole line; pages go by number, the
last marker of a number counts; the first footer line of a page gives its
printed number and the lowest page of a printed number is the one it means.
*Ingest* grammar (for segments): a marker stands anywhere; pages go by place,
each with its own number; the footer is looked for from the bottom.

All is done on arrays within a document's row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as X

# fixed values: marker and footer formats
QUERY_MARKER = r"^\{(\d+)\}-+$"
INGEST_MARKER = r"\{(\d+)\}-{3,}"
FOOTER_LEFT = r"^\**\s*(\d{1,4})\s*\**\s*\|\s*.*[A-Za-z].*$"
FOOTER_RIGHT = r"^.*[A-Za-z].*\s*\|\s*\**\s*(\d{1,4})\s*\**$"
# fixed values: footers of converted items, in the order they are tried
ITEM_FOOTERS = [r"^\s*(\d+)\s*$", r"[Pp]age\s+(\d+)", r"(?:^|\|)\s*(\d+)\s*(?:\||$)", r"(\d+)\s*$", r"^\s*(\d+)"]


def page_count(text: Column | str) -> Column:
    """Number of ingest markers."""
    return F.regexp_count(X.col(text), F.lit(INGEST_MARKER))


def number_in(line: Column, *patterns: str) -> Column:
    """The number that the first matching pattern finds; null if none does."""
    found = F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for p in patterns])
    if all(r"\|" in p for p in patterns):  # a line without the bar can't match
        found = F.when(F.contains(line, F.lit("|")), found)
    return found.try_cast("int")


def doc_pages(docs: DataFrame) -> DataFrame:
    """One row for each page by the query grammar: doc_id, physical_page,
    start_line, end_line (from 1), lines (array of number and text), printed_page.

    Where markers are out of order and ranges overlap, a line is of the page of
    the highest number; empty ranges are no pages (E1, E3, E5, C5)."""
    rows = docs.select("doc_id", X.lines("text").alias("_l"))
    rows = rows.withColumn("_m", F.expr("filter(transform(_l, (t, i) -> struct(if(startswith(t, '{'), try_cast(regexp_extract(t, r'" + QUERY_MARKER + "', 1) as int), null) as n, i as at)), m -> m.n is not null)"))
    # the last marker of each number, by number
    rows = rows.withColumn("_m", F.expr("array_sort(_m)"))
    rows = rows.withColumn("_m", F.expr("filter(_m, (m, i) -> i = size(_m) - 1 or _m[i + 1].n <> m.n)"))
    rows = rows.withColumn("_p", F.expr("filter(transform(_m, (m, i) -> struct(m.n as n, m.at + 1 as s, coalesce(get(_m, i + 1).at - 1, size(_l) - 1) as e)), p -> p.s <= p.e)"))
    rows = rows.withColumn("_mixed", F.expr("size(filter(_p, (p, i) -> i > 0 and _p[i - 1].e >= p.s)) > 0"))
    # a page carries its own lines only, and later ranges only where ranges overlap
    rows = rows.select("doc_id", F.explode(F.expr("""transform(_p, (p, i) -> struct(p.n as n, p.s as s, p.e as e, slice(_l, p.s + 1, p.e - p.s + 1) as t,
        if(_mixed, filter(slice(_p, i + 2, size(_p)), q -> q.s <= p.e and q.e >= p.s), slice(_p, 1, 0)) as later))""")).alias("_x"))
    own = "transform(_x.t, (t, i) -> struct(_x.s + i + 1 as line, t as text))"
    left = "filter(page_lines, l -> not exists(_x.later, q -> l.line - 1 between q.s and q.e))"
    pages = rows.withColumn("page_lines", F.expr(own))
    pages = pages.select("doc_id", F.col("_x.n").alias("physical_page"), (F.col("_x.s") + 1).alias("start_line"), (F.col("_x.e") + 1).alias("end_line"), "page_lines", F.when(F.size("_x.later") > 0, F.expr(left)).otherwise(F.col("page_lines")).alias("lines"))
    found = F.filter(F.transform("page_lines", lambda x: number_in(x["text"], SETTINGS.footer_left, SETTINGS.footer_right)), lambda n: n.isNotNull())
    return pages.withColumn("printed_page", F.get(found, F.lit(0)))


def page_map(pages: DataFrame) -> DataFrame:
    """(doc_id, printed_page, physical_page), the first page of each number."""
    return pages.where("printed_page is not null").groupBy("doc_id", "printed_page").agg(F.min("physical_page").alias("physical_page"))


def list_pages(pages: DataFrame) -> DataFrame:
    """What page numbers each document has."""
    return pages.groupBy("doc_id").agg(
        F.min("printed_page").alias("printed_page_min"),
        F.max("printed_page").alias("printed_page_max"),
        F.count_distinct("printed_page").alias("printed_page_count"),
        F.count("*").alias("physical_page_count"),
        (F.count("*") > F.count_distinct("printed_page")).alias("has_unmapped_pages"),
    )


def _ingested(text: str) -> Column:
    """The pages of a text by the ingest grammar, as an array within its row."""
    one = lambda n, t: F.struct(n.alias("page_number"), t.alias("text"))
    parts, numbers = F.split(text, INGEST_MARKER, -1), F.regexp_extract_all(text, F.lit(INGEST_MARKER), 1)
    each = lambda t, n: F.when(F.size(n) == 0, F.array(one(F.lit(0), F.get(t, F.lit(0))))).otherwise(F.transform(n, lambda x, i: one(x.try_cast("int"), F.get(t, i + 1))))
    return X.once(parts, lambda t: X.once(numbers, lambda n: each(t, n)))


def ingest_pages(docs: DataFrame) -> DataFrame:
    """One row for each page by the ingest grammar: doc_id, pos, page_number,
    text, printed_page. A text without marker is page 0; what stands before the
    first marker is none (E1, E4). A number that recurs keeps both places, each
    with the text of the last (as a reader by number would get)."""
    pages = docs.select("doc_id", F.posexplode(_ingested("text")).alias("pos", "_p")).select("doc_id", "pos", "_p.*")
    return pages.withColumn("printed_page", footer_number("text"))


def printed_pages(text: str) -> Column:
    """Within a document's row: (printed, pos, text) of the pages with a printed
    number, in that order, each with the text of the last page of its marker's
    number, without footer."""

    def last(p: Column, of: Column) -> Column:
        numbers = F.transform(of, lambda q: q["page_number"])
        same = F.filter(of, lambda q: q["page_number"].eqNullSafe(p["page_number"]))
        return F.when(F.size(F.array_distinct(numbers)) == F.size(of), p["text"]).otherwise(F.element_at(same, -1)["text"])

    def read(of: Column) -> Column:
        named = F.filter(F.transform(of, lambda p, i: F.struct(footer_number(p["text"]).alias("printed"), i.alias("pos"), last(p, of).alias("text"))), lambda x: x["printed"].isNotNull())
        return F.transform(F.array_sort(named), lambda x: F.struct(x["printed"].alias("printed"), x["pos"].alias("pos"), X.strip(strip_footer(x["text"], x["printed"])).alias("text")))

    return X.once(_ingested(text), read)


def _full_lines(text: Column | str) -> Column:
    return F.filter(F.transform(X.lines(X.strip(text)), X.strip), lambda x: x != "")


def footer_number(text: Column | str) -> Column:
    """The printed number: of the last five non-blank lines, the lowest that is a footer."""
    last = F.reverse(F.slice(F.reverse(_full_lines(text)), 1, 5))
    # without its bar a line can't match, and trying would cost the square of its length
    barred = F.filter(last, lambda x: F.contains(x, F.lit("|")))
    found = F.filter(F.transform(barred, lambda x: number_in(x, FOOTER_LEFT, FOOTER_RIGHT)), lambda n: n.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def strip_footer(text: Column | str, printed: Column | str) -> Column:
    """Drop the last non-blank line if it is a footer that holds the number (H8)."""
    rows = X.lines(text)
    place = F.array_max(F.filter(F.transform(rows, lambda x, i: F.when(X.strip(x) != "", i)), lambda i: i.isNotNull()))
    line = X.strip(F.get(rows, place))
    is_footer = F.contains(line, F.lit("|")) & (line.rlike(FOOTER_LEFT) | line.rlike(FOOTER_RIGHT)) & F.contains(line, X.col(printed).cast("string"))
    return F.array_join(F.when(F.coalesce(is_footer, F.lit(False)), F.filter(rows, lambda x, i: i != place)).otherwise(rows), "\n")


def first_n_pages(docs: DataFrame, n: int = SETTINGS.toc_pages) -> DataFrame:
    """doc_id, text of the pages before the first of number ``n`` or more, each
    under a header; a text without marker is whole (F2, H9)."""
    parts = docs.select("doc_id", "text", F.split("text", INGEST_MARKER, -1).alias("_t"), F.expr(f"transform(regexp_extract_all(text, r'{INGEST_MARKER}', 1), n -> cast(n as int))").alias("_n"))
    stop = F.expr(f"coalesce(array_min(filter(transform(_n, (n, i) -> if(n >= {n}, i, null)), i -> i is not null)), size(_n))")
    shown = F.transform(F.filter(F.transform("_n", lambda p, i: F.struct(p.alias("n"), F.get("_t", i + 1).alias("t"), i.alias("i"))), lambda p: p["i"] < F.col("_stop")), lambda p: F.concat(F.lit("--- Page "), (p["n"] + 1).cast("string"), F.lit(" ---\n"), X.strip(p["t"])))
    return parts.withColumn("_stop", stop).select("doc_id", F.when(F.size("_n") == 0, F.col("text")).otherwise(F.array_join(shown, "\n\n")).alias("text"))


def page_text(pages: DataFrame, requests: DataFrame, limit: int = SETTINGS.page_text_tokens, truncate=X.token_truncate) -> DataFrame:
    """Text of printed pages: requests (doc_id, printed_pages) to (doc_id, text,
    missing, found). Pages come in the order asked, repeats included, each under
    a header; over ``limit`` tokens the text is cut (by ``truncate``, which may
    know a vocabulary), then a note names missing pages; if none is there the
    text is null and ``error`` says so; an empty request gives an empty text
    (F6, F7, J2). Equal requests are answered once and returned as often as
    they were made; pages that nobody asks for go no further."""
    asked = requests.groupBy("doc_id", "printed_pages").agg(F.count("*").alias("_times"))
    wanted = asked.select("doc_id", "printed_pages", F.posexplode_outer("printed_pages").alias("_k", "printed_page"))
    named = wanted.select("doc_id", "printed_page").distinct()
    # a page shows its whole range, not just the lines that no later page claims
    body = F.min_by(F.transform("page_lines", lambda x: x["text"]), "physical_page")
    shown = pages.join(named, ["doc_id", "printed_page"], "left_semi").groupBy("doc_id", "printed_page").agg(X.strip(F.array_join(body, "\n")).alias("_body"))
    got = wanted.join(shown, ["doc_id", "printed_page"], "left")
    part = F.struct(F.col("_k"), F.col("printed_page").alias("p"), F.col("_body").alias("b"))
    grouped = got.groupBy("doc_id", "printed_pages").agg(F.array_sort(F.collect_list(F.when(F.col("printed_page").isNotNull(), part))).alias("_x"))
    there, missing = F.filter("_x", lambda x: x["b"].isNotNull()), F.transform(F.filter("_x", lambda x: x["b"].isNull()), lambda x: x["p"])
    joined = F.array_join(F.transform(there, lambda x: F.concat(F.lit("--- Printed page "), x["p"].cast("string"), F.lit(" ---\n"), x["b"])), "\n\n")
    note = F.when(F.size("missing") > 0, F.concat(F.lit("\n\n[note: printed pages with no footer mapping skipped: ["), F.array_join(F.col("missing").cast("array<string>"), ", "), F.lit("]]"))).otherwise("")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("doc_id", "printed_pages")]
    out = asked.alias("a").join(grouped.alias("g"), same).select("a.doc_id", "a.printed_pages", "_times", "_x")
    out = out.withColumn("missing", missing).withColumn("found", F.size(there)).withColumn("_j", joined)
    none = (F.col("found") == 0) & (F.size("missing") > 0)
    error = F.when(none, F.concat(F.lit("none of the printed pages is mapped: ["), F.array_join(F.col("missing").cast("array<string>"), ", "), F.lit("]")))
    out = out.select("doc_id", "printed_pages", F.when(~none, F.concat(truncate("_j", limit), note)).alias("text"), "missing", "found", error.alias("error"), "_times")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_n", "_times")


def item_footer(text: Column | str) -> Column:
    """Number of a footer item: the first pattern that matches decides, and a
    number outside 1..9999 is none (B17)."""
    text = X.strip(text)
    decided = F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in ITEM_FOOTERS]).try_cast("int")
    return F.when(decided.between(1, 9999), decided)


def item_pages(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Page labels overridden by footers: items (doc_id, seq, page_no, kind,
    text), labels (doc_id, page_no, label); the first footer item of a page with
    a number wins (A23, C10)."""
    feet = items.where("kind = 'footer'").withColumn("n", item_footer("text")).where("n is not null")
    best = feet.groupBy("doc_id", "page_no").agg(F.min_by("n", "seq").cast("string").alias("footer"))
    return labels.join(best, ["doc_id", "page_no"], "full_outer").select("doc_id", "page_no", F.coalesce("footer", "label").alias("label"))


def rendered_items(items: DataFrame) -> DataFrame:
    """Pages rendered from items in order: headings, lists, code, text; headers
    and footers left out (A23, B18, E11, H17)."""
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.coalesce(F.col("level"), F.lit(1)))), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "list", F.concat(F.lit("- "), F.col("text")))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    body = items.where("kind not in ('header', 'footer')").withColumn("_s", shown)
    return body.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_s"))), lambda x: x["_s"]), "\n\n").alias("text"))
