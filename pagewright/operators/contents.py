"""Tables of contents read from the documents themselves.

Entries are lines of the first pages that end in a page number after leaders,
spaces or a cell bar. Headings are lines of the body that say the same as an
entry: without case, marks, numbering and markup. A heading may stand in many
places (running titles, repeats in the text), so an entry's place is decided by
all entries of its document together: of the places found, the heaviest chain
that rises in both the order of entries and the order of lines is taken. A place
weighs more if it is marked up as a heading, and if its printed number is the
entry's, counted from the offset that most places of the document agree on.

The page of an entry in the chain is the printed page of its heading; an entry
without a place keeps its own number, corrected by that offset. So wrong numbers
and numbers counted from elsewhere are mended where the body tells."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as X

#: a title with a letter, then leaders, wide space or a bar, then a number
ENTRY = r"^[\s|*#>-]*(.*\p{L}.*?)(?:\s*[.…·_]{2,}\s*|\s{2,}|\s*\t\s*|\s*\|\s*)\**(\d{1,4})\**[\s|]*$"
#: what a heading may have before its words
MARKUP = r"^\s*#{1,6}\s|^\s*\*\*.*\*\*\s*$"
NUMBERING = r"^\s*(?:(?:chapter|section|part)\s+)?(?:\d+(?:\.\d+)*|[ivxlc]+)[.:)]?\s+(?=\S)"
#: weights of a place: that it is one, marked up, of the right number
PLACE, MARKED, NUMBERED = 4, 2, 3


def title_key(text: Column | str) -> Column:
    """What two spellings of a title have in common; empty if there is no word."""
    plain = F.lower(F.regexp_replace(X.col(text), r"[#*_`|>]+", " "))
    bare = F.regexp_replace(F.trim(plain), NUMBERING, "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def entries(pages: DataFrame, first: int = SETTINGS.toc_pages) -> DataFrame:
    """(doc_id, entry_no, line, title, number, key) of the contents' lines, which
    stand on pages before the one of number ``first``."""
    each = pages.where(F.col("physical_page") < first).select("doc_id", F.explode("page_lines").alias("x"))
    # without a digit at its end a line can't be an entry
    kept = each.where(F.col("x.text").rlike(r"\d\**[\s|]*$")).select("doc_id", F.col("x.line").alias("line"), F.col("x.text").alias("text"))
    found = kept.where(F.col("text").rlike(ENTRY) & ~F.col("text").rlike(SETTINGS.footer_left) & ~F.col("text").rlike(SETTINGS.footer_right))
    named = found.select("doc_id", "line", F.trim(F.regexp_extract("text", ENTRY, 1)).alias("title"), F.regexp_extract("text", ENTRY, 2).cast("int").alias("number"))
    return named.withColumn("key", title_key("title")).where("key <> ''")


def places(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, key, line, printed_page, marked): lines that say what an entry says
    and are no entry themselves; an equi-join on document and key."""
    each = pages.select("doc_id", "physical_page", "printed_page", F.explode("lines").alias("x"))
    lines = each.select("doc_id", "printed_page", F.col("x.line").alias("line"), F.col("x.text").alias("text")).where(F.length("text").between(1, 300))
    lines = lines.withColumn("key", title_key("text")).where("key <> ''")
    wanted = found.select("doc_id", "key").distinct()
    own = found.select("doc_id", "line")
    return lines.join(wanted, ["doc_id", "key"]).join(own, ["doc_id", "line"], "left_anti").select("doc_id", "key", "line", "printed_page", F.col("text").rlike(MARKUP).alias("marked"))


def heaviest_chain(items: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of the items (entry, line, weight) of the heaviest chain in which
    both entry and line rise; of equals the one that ends first."""
    lines = sorted({line for _, line, _ in items})
    best: list[tuple[int, int]] = [(0, -1)] * (len(lines) + 1)  # a tree of prefix maxima: weight, item
    before = [-1] * len(items)

    def upto(place: int) -> tuple[int, int]:
        out = (0, -1)
        while place:
            out = max(out, best[place], key=lambda x: x[0])
            place &= place - 1
        return out

    order = sorted(range(len(items)), key=lambda n: (items[n][0], -items[n][1]))
    end = (0, -1)
    for n in order:
        _, line, weight = items[n]
        place = bisect_left(lines, line)
        held, before[n] = upto(place)
        total = (held + weight, n)
        if total[0] > end[0]:
            end = total
        place += 1
        while place <= len(lines):
            if total[0] > best[place][0]:
                best[place] = total
            place += place & -place
    out, n = [], end[1]
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def aligned(toc: list[dict], held: list[dict]) -> list[tuple[int, int | None, bool]]:
    """(entry, page, whether its heading was found) of one document's entries, in
    their order."""
    toc = sorted(toc, key=lambda e: e["line"])
    by_key: dict[str, list[dict]] = {}
    for p in held:
        by_key.setdefault(p["key"], []).append(p)
    offsets = Counter(p["printed_page"] - e["number"] for e in toc for p in by_key.get(e["key"], []) if p["printed_page"] is not None)
    offset = min(offsets, key=lambda o: (-offsets[o], abs(o), o)) if offsets else 0
    items = [
        (n, p["line"], PLACE + MARKED * bool(p["marked"]) + NUMBERED * (p["printed_page"] is not None and p["printed_page"] == e["number"] + offset), p["printed_page"])
        for n, e in enumerate(toc)
        for p in by_key.get(e["key"], [])
        if p["line"] > e["line"]
    ]
    chosen = {items[k][0]: items[k][3] for k in heaviest_chain([i[:3] for i in items])}
    return [(n, chosen[n] if chosen.get(n) is not None else e["number"] + offset, n in chosen) for n, e in enumerate(toc)]


def toc_extract(pages: DataFrame, first: int = SETTINGS.toc_pages) -> DataFrame:
    """(doc_id, pos, section_name, page_number, stated, found): the contents of each
    document with the page where each section begins, the number that the entry
    states and whether its heading was found.

    ``pages`` are those of ``doc_pages`` (kept ones are read twice); a document
    without entries has no row; entries of equal words are told apart by order;
    null ids are left out, empty tables give no row."""
    rows = pages.where("doc_id is not null")
    found = entries(rows, first)
    marked = F.struct("key", "line", "printed_page", "marked")
    headings = places(rows, found).groupBy("doc_id").agg(F.collect_list(marked).alias("held"))
    contents = found.groupBy("doc_id").agg(F.collect_list(F.struct("line", "title", "number", "key")).alias("toc"))
    both = contents.join(headings, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for n, (toc, held) in enumerate(zip(batch.column("toc").to_pylist(), batch.column("held").to_pylist(), strict=True)):
                toc.sort(key=lambda e: e["line"])
                for pos, page, there in aligned(toc, held or []):
                    keys.append(n)
                    out.append((pos, toc[pos]["title"], page, toc[pos]["number"], there))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keys, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "pos", "section_name", "page_number", "stated", "found"])

    kind = dict(both.dtypes)["doc_id"]
    return both.mapInArrow(run, f"doc_id {kind}, pos int, section_name string, page_number int, stated int, found boolean")
