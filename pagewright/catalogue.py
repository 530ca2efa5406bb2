"""Registered queries of the document operators, each with DuckDB SQL;
``record_queries`` has more of them.

The corpus is ``documents`` rendered to marked-up pages; the SQL computes the
same answers by arithmetic on line numbers and never parses the rendered text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as X
from .lineage import shared_folder
from .operators import clean, contents, grep, index, pages, payloads, reduce, segments, store, traces
from .plans import planner
from .sources import corpus
from .streaming import scopes

t = corpus.tables


def _docs(spark, d):
    return corpus.paginated(t(spark, d, "documents"))


def _pages(spark, d):
    return pages.doc_pages(_docs(spark, d))


#: source lines with their page (p), place in the rendered text (line) and text
LINES = """
src AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, i, l[i + 1] AS s, len(l) AS n FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM src)),
pg AS (SELECT doc_id, CAST(i // 12 AS INTEGER) AS p, CASE WHEN i // 12 >= 1 THEN CAST(i // 12 AS INTEGER) END AS printed,
         CAST(12 * (i // 12) + (i // 12 + 1) + greatest(i // 12 - 1, 0) + i % 12 + 1 AS INTEGER) AS line, s, n FROM ln),
page AS (SELECT doc_id, p, printed, min(line) AS first_line, max(line) + CASE WHEN p >= 1 THEN 1 ELSE 0 END AS last_line,
           string_agg(s, chr(10) ORDER BY line) AS body, any_value(n) AS n FROM pg GROUP BY doc_id, p, printed)
"""


def page_split(spark, d) -> DataFrame:
    return _pages(spark, d).select("doc_id", "physical_page", "start_line", "end_line", "printed_page")


PAGE_SPLIT = f"WITH {LINES} SELECT doc_id, p AS physical_page, first_line AS start_line, last_line AS end_line, printed AS printed_page FROM page"


def page_map_first(spark, d) -> DataFrame:
    return pages.page_map(_pages(spark, d))


PAGE_MAP_FIRST = f"WITH {LINES} SELECT doc_id, printed AS printed_page, p AS physical_page FROM page WHERE printed IS NOT NULL"


def page_map_all(spark, d) -> DataFrame:
    """Ingest grammar: number of each page, its footer, and its length without it."""
    found = pages.ingest_pages(_docs(spark, d))
    return found.select("doc_id", "pos", "page_number", "printed_page", F.length(X.strip(pages.strip_footer("text", F.coalesce("printed_page", F.lit(-1))))).alias("n_chars"))


PAGE_MAP_ALL = rf"""WITH {LINES} SELECT doc_id, p AS pos, p AS page_number, printed AS printed_page,
  CAST(length(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS INTEGER) AS n_chars FROM page"""


def list_pages(spark, d) -> DataFrame:
    return pages.list_pages(_pages(spark, d))


LIST_PAGES = f"""WITH {LINES} SELECT doc_id, min(printed) AS printed_page_min, max(printed) AS printed_page_max, count(printed) AS printed_page_count,
  count(*) AS physical_page_count, count(*) > count(printed) AS has_unmapped_pages FROM page GROUP BY doc_id"""


def page_counts(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", pages.page_count("text").cast("int").alias("page_count"))


PAGE_COUNTS = f"WITH {LINES} SELECT doc_id, CAST(count(*) AS INTEGER) AS page_count FROM page GROUP BY doc_id"


def first_n_pages(spark, d) -> DataFrame:
    return pages.first_n_pages(_docs(spark, d), 3)


FIRST_N_PAGES = rf"""WITH {LINES} SELECT doc_id, string_agg('--- Page ' || (p + 1) || ' ---' || chr(10) ||
  regexp_replace(body || CASE WHEN p = 0 THEN '' WHEN p % 2 = 1 THEN chr(10) || p || ' | Report' ELSE chr(10) || 'Report | ' || p END, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY p) AS text
  FROM page WHERE p < 3 GROUP BY doc_id"""


def _matches(where: str, snippet: str, limit: int, keys: str = "doc_id", source: str = "pg", extra: str = "") -> str:
    return f"""SELECT * EXCLUDE (k) FROM (SELECT {extra} doc_id, printed AS printed_page, p AS physical_page, line, {snippet} AS snippet,
      row_number() OVER (PARTITION BY {keys} ORDER BY line) AS k FROM {source} WHERE s <> '' AND {where}) WHERE k <= {limit}"""


def _snippet(start: str, size: str) -> str:
    return f"""(CASE WHEN {start} - 1 > 200 THEN '…' ELSE '' END || substring(s, greatest({start} - 200, 1), least({start} - 1 + {size} + 200, length(s)) - greatest({start} - 201, 0))
      || CASE WHEN {start} - 1 + {size} + 200 < length(s) THEN '…' ELSE '' END)"""


def grep_literal(spark, d) -> DataFrame:
    return grep.grep(_pages(spark, d), "THE TH")


GREP_LITERAL = f"WITH {LINES} {_matches("contains(lower(s), 'the th')", _snippet("instr(lower(s), 'the th')", "6"), 20)}"


def grep_regex(spark, d) -> DataFrame:
    return grep.grep(_pages(spark, d), "ti(?P<x>on|ng)s? the", regex=True, limit=5)


GREP_REGEX = f"""WITH {LINES} {_matches("regexp_matches(s, '(?i)ti(on|ng)s? the')", _snippet("(length(regexp_extract(s, '(?is)^(.*?)ti(?:on|ng)s? the', 1)) + 1)", "length(regexp_extract(s, '(?i)ti(?:on|ng)s? the'))"), 5)}"""


def _indexed(spark, d) -> str:
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index.add(_pages(spark, d), path)
    return path


def grep_indexed(spark, d) -> DataFrame:
    """Every matching line, by the kept index."""
    return index.grep_indexed(spark, _indexed(spark, d), "THE TH")


GREP_INDEXED = f"WITH {LINES} {_matches("contains(lower(s), 'the th')", _snippet("instr(lower(s), 'the th')", "6"), 10**9)}"


def grep_indexed_regex(spark, d) -> DataFrame:
    return index.grep_indexed(spark, _indexed(spark, d), "ti(?P<x>on|ng)s? the", regex=True)


GREP_INDEXED_REGEX = GREP_REGEX.replace("k <= 5", f"k <= {10**9}")


def kept_pages(spark, d) -> DataFrame:
    """What pages each document has, read from the index."""
    return pages.list_pages(index.pages(spark, _indexed(spark, d)))


def grep_page_filter(spark, d) -> DataFrame:
    return grep.grep(_pages(spark, d), "en", pages_filter=[1, 3, 4000], limit=3)


GREP_PAGE_FILTER = f"WITH {LINES} {_matches("contains(lower(s), 'en') AND printed IN (1, 3)", _snippet("instr(lower(s), 'en')", "2"), 3)}"


def grep_unmapped_filter(spark, d) -> DataFrame:
    """Only unknown pages: no match."""
    return grep.grep(_pages(spark, d), "en", pages_filter=[9999])


GREP_UNMAPPED = f"WITH {LINES} {_matches("false", "s", 20)}"


def _toc(spark, d) -> DataFrame:
    """A section every second printed page; documents of id divisible by 7 get a
    second entry on page 1; one entry has no number."""
    last = t(spark, d, "documents").where("text is not null").select("doc_id", (F.floor((F.size(F.split("text", "\n", -1)) - 1) / 12)).cast("int").alias("most")).where("most >= 1")
    base = last.select("doc_id", F.posexplode(F.expr("sequence(1, most, 2)")).alias("pos", "page_number"))
    twin = last.where("doc_id % 7 = 0").select("doc_id", F.lit(1000).alias("pos"), F.lit(1).alias("page_number"))
    none = last.where("doc_id % 5 = 0").select("doc_id", F.lit(1001).alias("pos"), F.lit(None).cast("int").alias("page_number"))
    every = base.unionByName(twin).unionByName(none)
    return every.select("doc_id", "pos", F.concat(F.lit("Section "), F.col("pos").cast("string")).alias("section_name"), F.concat(F.lit("Chapter "), F.floor(F.col("pos") / 3).cast("string")).alias("chapter_name"), "page_number")


TOC = f"""{LINES},
last AS (SELECT doc_id, max(printed) AS most FROM page GROUP BY doc_id HAVING max(printed) IS NOT NULL),
entry AS (
  SELECT doc_id, k AS pos, 2 * k + 1 AS page_number, most FROM (SELECT doc_id, most, unnest(range(0, (most + 1) // 2)) AS k FROM last)
  UNION ALL SELECT doc_id, 1000, 1, most FROM last WHERE doc_id % 7 = 0),
rg AS (SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS toc_no, 'Section ' || pos AS section_name, 'Chapter ' || (pos // 3) AS chapter_name,
         CAST(page_number AS INTEGER) AS start_page, CAST(greatest(page_number, coalesce(lead(page_number) OVER w - 1, most)) AS INTEGER) AS end_page
       FROM entry WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, pos)),
body AS (SELECT doc_id, p, printed, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS b FROM page WHERE printed IS NOT NULL),
sec AS (SELECT rg.doc_id, toc_no, section_name, chapter_name, list(printed ORDER BY printed) AS pages, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY printed) FILTER (b <> ''), '') AS text
        FROM rg JOIN body ON body.doc_id = rg.doc_id AND printed BETWEEN start_page AND end_page GROUP BY ALL)
"""


def toc_extract(spark, d) -> DataFrame:
    """Contents on the first page, headings in the text of every second page: every
    seventh page lacks its heading, every fifth has a wrong number, documents of id
    divisible by 3 count from elsewhere, and page 1 names the section of page 3."""
    title = lambda p: F.concat(F.lit("Heading about page "), p.cast("string"))
    stated = lambda p: p + F.when(F.col("doc_id") % 3 == 0, 10).otherwise(0) + F.when(p % 5 == 0, 2).otherwise(0)
    rows = t(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("l"))
    rows = rows.withColumn("n", F.ceil(F.size("l") / 12).cast("int"))
    entry = lambda p: F.concat(title(p), F.when(p % 4 == 1, " ..... ").otherwise(" | "), stated(p).cast("string"))

    def page(p):
        head = F.when((p % 2 == 1) & (p % 7 != 0), F.concat(F.lit("## "), F.upper(title(p)), F.lit("\n"))).otherwise("")
        named = F.when((p == 1) & (F.col("n") >= 3), F.concat(title(F.lit(3)), F.lit("\n"))).otherwise("")
        return F.concat(F.lit("\n{"), p.cast("string"), F.lit("}-----\n"), head, named, F.array_join(F.slice("l", (p - 1) * 12 + 1, F.lit(12)), "\n"), F.lit("\nReport | "), p.cast("string"))

    first = F.concat(F.lit("{0}-----\nContents\n"), F.array_join(F.transform(F.expr("sequence(1, n, 2)"), entry), "\n"))
    text = F.concat(first, F.array_join(F.transform(F.expr("sequence(1, n)"), page), ""))
    return contents.toc_extract(pages.doc_pages(rows.select("doc_id", text.alias("text"))), first=1)


TOC_EXTRACT = """WITH e AS (SELECT doc_id, unnest(range(1, (len(string_split(text, chr(10))) + 11) // 12 + 1, 2)) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(p // 2 AS INTEGER) AS pos, 'Heading about page ' || p AS section_name, CAST(p + CASE WHEN p % 7 = 0 AND p % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS page_number,
  CAST(p + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN p % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS stated, p % 7 <> 0 AS found FROM e"""


def toc_ranges(spark, d) -> DataFrame:
    return segments.toc_ranges(_toc(spark, d), _pages(spark, d))


TOC_RANGES = f"WITH {TOC} SELECT * FROM rg"


def section_pages(spark, d) -> DataFrame:
    found = pages.ingest_pages(_docs(spark, d))
    return segments.section_pages(segments.toc_ranges(_toc(spark, d), found), found).select("doc_id", "toc_no", "section_name", "printed_page", "pos")


SECTION_PAGES = f"WITH {TOC} SELECT rg.doc_id, toc_no, section_name, printed AS printed_page, p AS pos FROM rg JOIN body ON body.doc_id = rg.doc_id AND printed BETWEEN start_page AND end_page"


def _sections(spark, d) -> DataFrame:
    return segments.sections(_docs(spark, d), _toc(spark, d))


def section_text(spark, d) -> DataFrame:
    return _sections(spark, d).select("doc_id", "toc_no", "section_name", "chapter_name", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "text")


SECTION_TEXT = f"WITH {TOC} SELECT doc_id, toc_no, section_name, chapter_name, array_to_string(pages, ',') AS pages, text FROM sec WHERE text <> ''"


def segments_fixed(spark, d) -> DataFrame:
    return segments.fixed_width(_sections(spark, d), 400).select("doc_id", "seg_no", "seg_id", "section_name", "token_count", "text")


SEGMENTS_FIXED = f"""WITH {TOC} SELECT doc_id, CAST(g AS INTEGER) AS seg_no, printf('s_%03d', g) AS seg_id, section_name, CAST(ceil(length(c) / 4.0) AS INTEGER) AS token_count, c AS text FROM (
  SELECT doc_id, section_name, row_number() OVER (PARTITION BY doc_id ORDER BY toc_no, k) - 1 AS g, substring(text, k * 400 + 1, 400) AS c
  FROM (SELECT *, unnest(range(0, (length(text) - 1) // 400 + 1)) AS k FROM sec WHERE text <> ''))"""


def segments_recursive(spark, d) -> DataFrame:
    return segments.segments(_docs(spark, d), _toc(spark, d), 1000, 100).select("doc_id", "seg_id", "section_name", "chapter_name", "token_count", "text")


def grep_section(spark, d) -> DataFrame:
    return grep.grep_sections(_pages(spark, d), _sections(spark, d), "er", limit=2)


GREP_SECTION = f"""WITH {TOC}, sl AS (SELECT DISTINCT sec.section_name, pg.* FROM sec JOIN pg ON pg.doc_id = sec.doc_id AND list_contains(sec.pages, pg.printed) WHERE text <> '')
{_matches("contains(lower(s), 'er')", _snippet("instr(lower(s), 'er')", "2"), 2, "doc_id, section_name", "sl", "section_name,")}"""


def grep_many(spark, d) -> DataFrame:
    """Every run of five words of every benchmark item, and its words of 9 letters or more."""
    items = t(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 5).cast("int")), lambda k: F.array_join(F.slice("w", k * 5 + 1, F.lit(5)), " "))
    five = items.select("item_id", F.posexplode(runs).alias("k", "pattern")).select((F.col("item_id") * 1000 + F.col("k")).alias("pattern_id"), "pattern")
    one = items.select("item_id", F.posexplode("w").alias("k", "pattern")).where(F.length("pattern") >= 9).select((F.col("item_id") * 1000 + 500 + F.col("k")).alias("pattern_id"), "pattern")
    return grep.grep_many(_pages(spark, d), five.unionByName(one), 4)


GREP_MANY = f"""WITH {LINES}, w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), pat AS (
  SELECT item_id * 1000 + k AS pattern_id, lower(array_to_string(w[5 * k + 1:5 * k + 5], ' ')) AS q FROM (SELECT *, unnest(range(0, (len(w) - 1) // 5 + 1)) AS k FROM w)
  UNION ALL SELECT item_id * 1000 + 500 + k, lower(w[k + 1]) FROM (SELECT *, unnest(range(0, len(w))) AS k FROM w) WHERE length(w[k + 1]) >= 9)
SELECT * EXCLUDE (k) FROM (SELECT pattern_id, doc_id, printed AS printed_page, p AS physical_page, line, row_number() OVER (PARTITION BY pattern_id, doc_id ORDER BY line) AS k
  FROM pg JOIN pat ON contains(lower(s), q) WHERE s <> '') WHERE k <= 4"""


def _quotes(spark, d) -> DataFrame:
    """Some words of every line of 12 or more characters, said to be on page 1 or 2,
    and words that stand nowhere."""
    line = F.col("s")
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "s"))
    return docs.select((F.col("doc_id") * 100000 + F.col("k")).alias("quote_id"), "doc_id", (F.col("doc_id") % 2 + 1).cast("int").alias("printed_page"), F.when(F.length(line) >= 12, F.substring(line, 3, 25)).otherwise("no such words").alias("quote"))


def verify_quotes(spark, d) -> DataFrame:
    return grep.verify_quotes(_pages(spark, d), _quotes(spark, d)).select("quote_id", "status", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


VERIFY_QUOTES = f"""WITH {LINES}, q AS (SELECT doc_id * 100000 + i AS quote_id, doc_id, doc_id % 2 + 1 AS want, lower(CASE WHEN length(s) >= 12 THEN substring(s, 3, 25) ELSE 'no such words' END) AS q FROM ln),
h AS (SELECT quote_id, bool_or(coalesce(printed = want, false)) AS here, string_agg(DISTINCT printed, ',' ORDER BY printed) AS pages FROM q JOIN pg ON pg.doc_id = q.doc_id AND contains(lower(s), q) GROUP BY quote_id)
SELECT q.quote_id, CASE WHEN here THEN 'found' WHEN here IS NOT NULL THEN 'other page' ELSE 'absent' END AS status, coalesce(pages, '') AS pages FROM q LEFT JOIN h ON h.quote_id = q.quote_id"""


def page_text(spark, d) -> DataFrame:
    """Pages 2, 1, 2 and 77 of each document: order kept, repeats kept, a note."""
    asked = t(spark, d, "documents").where("text is not null").select("doc_id", F.array(F.lit(2), F.lit(1), F.lit(2), F.lit(77)).alias("printed_pages"))
    return pages.page_text(_pages(spark, d), asked, 300).select("doc_id", "text", "found", "error")


PAGE_TEXT = rf"""WITH {LINES}, b AS (SELECT doc_id, printed, '--- Printed page ' || printed || ' ---' || chr(10) || regexp_replace(body || CASE WHEN p % 2 = 1 THEN chr(10) || p || ' | Report' ELSE chr(10) || 'Report | ' || p END, '^\s+|\s+$', '', 'g') AS x FROM page WHERE printed IS NOT NULL),
r AS (SELECT doc_id, k, (CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 77 END) AS w FROM src, range(1, 5) AS z(k)),
j AS (SELECT r.doc_id, string_agg(x, chr(10) || chr(10) ORDER BY k) AS t, CAST(count(x) AS INTEGER) AS found, array_to_string(list(w ORDER BY k) FILTER (x IS NULL), ', ') AS miss FROM r LEFT JOIN b ON b.doc_id = r.doc_id AND b.printed = w GROUP BY r.doc_id)
SELECT doc_id, CASE WHEN found > 0 THEN (CASE WHEN length(t) <= 1200 THEN t ELSE substring(t, 1, 1200) || chr(10) || chr(10) || '[truncated at ~300 tokens]' END)
  || CASE WHEN miss <> '' THEN chr(10) || chr(10) || '[note: printed pages with no footer mapping skipped: [' || miss || ']]' ELSE '' END END AS text, found,
  CASE WHEN found = 0 THEN 'none of the printed pages is mapped: [' || miss || ']' END AS error FROM j"""


def clean_images(spark, d) -> DataFrame:
    """Image lines put before each document's first line: none, alt text next, alt
    text later, alt text nowhere, by doc_id mod 4."""
    docs = t(spark, d, "documents").where("text is not null")
    alt = F.concat(F.lit("Chart "), F.col("doc_id").cast("string"))
    image = F.concat(F.lit("!["), alt, F.lit("](x.JPG)"))
    case = F.col("doc_id") % 4
    text = F.when(case == 0, F.col("text")).when(case == 1, F.concat_ws("\n", image, F.lit(""), alt, F.col("text"))).when(case == 2, F.concat_ws("\n", image, F.lit("rich words"), F.lit(""), F.lit(""), F.lit(""), alt, F.col("text"))).otherwise(F.concat_ws("\n", image, F.lit("# Head"), alt, F.col("text")))
    return clean.clean_images(docs.select("doc_id", text.alias("text"))).drop("shrink_percent")


CLEAN_IMAGES = r"""SELECT doc_id, regexp_replace(CASE doc_id % 4 WHEN 0 THEN b WHEN 1 THEN chr(10) || a || chr(10) || b WHEN 2 THEN 'rich words' || chr(10) || chr(10) || b
    ELSE 'Figure: ' || a || chr(10) || '# Head' || chr(10) || a || chr(10) || b END, '\n{3,}', chr(10) || chr(10), 'g') AS text,
  CAST(doc_id % 4 = 1 AS INTEGER) AS n_next, CAST(doc_id % 4 = 2 AS INTEGER) AS n_later, CAST(doc_id % 4 = 3 AS INTEGER) AS n_figure
FROM (SELECT doc_id, 'Chart ' || doc_id AS a, CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END AS b FROM documents WHERE text IS NOT NULL)"""


def _analyses(spark, d) -> DataFrame:
    """A finding for each document as a segment of its source: level by labels,
    pages by doc_id."""
    rated = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return rated.select(
        F.crc32("source").alias("doc_id"), F.col("doc_id").alias("seg_no"), F.concat(F.lit("s_"), F.col("doc_id").cast("string")).alias("seg_id"),
        F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(F.lit("S"), (F.col("doc_id") % 3).cast("string"))).alias("section_name"), F.col("lang").alias("chapter_name"),
        F.when(F.col("doc_id") % 6 == 0, None).otherwise(F.array((F.col("doc_id") % 9).cast("int"), (F.col("doc_id") % 5).cast("int"))).alias("pages"),
        F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").otherwise("medium").alias("ocr_confidence"),
        (F.col("n_chars") % 7 == 0).alias("has_table"), (F.col("n_chars") % 13 == 0).alias("has_figure"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("n_chars") % 2 == 0, "positive").otherwise("neutral").alias("sentiment"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("summary"),
        F.array(F.concat(F.lit("Topic  "), (F.col("n_chars") % 4).cast("string")), F.concat(F.lit("topic "), (F.col("n_chars") % 3).cast("string"))).alias("topics"),
        F.array(F.col("lang")).alias("salient_quotes"),
    )


ANALYSES = """a AS (SELECT doc_id AS seg_no, crc AS doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'S' || (doc_id % 3) END AS section_name, lang AS chapter_name,
  CASE WHEN doc_id % 6 = 0 THEN [] ELSE [doc_id % 9, doc_id % 5] END AS pages, CASE WHEN quality = 0 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS c,
  n_chars % 7 = 0 AS ht, n_chars % 13 = 0 AS hf, CASE WHEN toxic = 1 THEN 'negative' WHEN n_chars % 2 = 0 THEN 'positive' ELSE 'neutral' END AS s
  FROM (SELECT d.*, quality, toxic, source AS crc FROM documents d LEFT JOIN labels USING (doc_id)))"""

SENTIMENT = """CASE WHEN count(*) FILTER (s = 'positive') > 0 AND count(*) FILTER (s = 'negative') > 0 THEN 'mixed'
  WHEN count(*) FILTER (s = 'positive') > greatest(count(*) FILTER (s = 'negative'), count(*) FILTER (s = 'neutral')) THEN 'positive'
  WHEN count(*) FILTER (s = 'negative') > greatest(count(*) FILTER (s = 'positive'), count(*) FILTER (s = 'neutral')) THEN 'negative' ELSE 'neutral' END"""


def _flat(df: DataFrame, lists: list[str], ids: str) -> DataFrame:
    out = df.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))
    return out.select(F.col("doc_id").alias("source"), ids, "pages", *[F.array_join(c, ",").alias(c) for c in lists], "ocr_confidence", "has_table", "has_figure", "sentiment")


def reduce_sections(spark, d) -> DataFrame:
    found = reduce.reduce_sections(_analyses(spark, d).withColumn("doc_id", F.col("seg_no") % 40))
    return _flat(found, ["segment_ids"], "section_name")


REDUCE_SECTIONS = f"""WITH {ANALYSES.replace("source AS crc", "doc_id % 40 AS crc")}
SELECT doc_id AS source, section_name, coalesce(array_to_string(list_sort(list_distinct(flatten(list(pages)))), ','), '') AS pages, string_agg('s_' || seg_no, ',' ORDER BY seg_no) AS segment_ids,
  (['low', 'medium', 'high'])[min(c) + 1] AS ocr_confidence, bool_or(ht) AS has_table, bool_or(hf) AS has_figure, {SENTIMENT} AS sentiment FROM a GROUP BY doc_id, section_name"""


def reduce_chapters(spark, d) -> DataFrame:
    """Sections of each document group reduced to two chapters."""
    base = _analyses(spark, d).withColumn("doc_id", F.col("seg_no") % 40).withColumn("chapter_name", F.when(F.col("section_name") == "S1", "one").otherwise("two"))
    found = reduce.reduce_chapters(reduce.reduce_sections(base))
    return _flat(found, ["section_names"], "chapter_name").drop("sentiment")


REDUCE_CHAPTERS = f"""WITH {ANALYSES.replace("source AS crc", "doc_id % 40 AS crc")},
s AS (SELECT doc_id, section_name, CASE WHEN section_name = 'S1' THEN 'one' ELSE 'two' END AS chapter_name, list_sort(list_distinct(flatten(list(pages)))) AS pages, min(c) AS c, bool_or(ht) AS ht, bool_or(hf) AS hf FROM a GROUP BY ALL)
SELECT doc_id AS source, chapter_name, coalesce(array_to_string(list_sort(list_distinct(flatten(list(pages)))), ','), '') AS pages,
  string_agg(section_name, ',' ORDER BY coalesce(list_min(pages), 1000000000), section_name) AS section_names,
  (['low', 'medium', 'high'])[min(c) + 1] AS ocr_confidence, bool_or(ht) AS has_table, bool_or(hf) AS has_figure FROM s GROUP BY doc_id, chapter_name"""


def topics_union(spark, d) -> DataFrame:
    rows = _analyses(spark, d).select((F.col("seg_no") % 40).alias("doc_id"), "seg_no", F.posexplode("topics").alias("k", "topic")).withColumn("ord", F.col("seg_no") * 2 + F.col("k"))
    return reduce.distinct_texts(rows, ["doc_id"], "topic", "ord").select("doc_id", "topic")


TOPICS_UNION = """WITH x AS (SELECT doc_id % 40 AS g, doc_id * 2 AS o, 'Topic  ' || (n_chars % 4) AS t FROM documents UNION ALL SELECT doc_id % 40, doc_id * 2 + 1, 'topic ' || (n_chars % 3) FROM documents)
SELECT g AS doc_id, arg_min(t, o) AS topic FROM x GROUP BY g, regexp_replace(lower(t), '\\s+', ' ', 'g')"""


def _metric_rows(spark, d) -> DataFrame:
    """Events as metrics: name, month, value; the child is the user."""
    e = t(spark, d, "events")
    return e.select(
        (F.col("user_id") % 50).alias("doc_id"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM").alias("time_period"), F.lit("u").alias("unit"),
        F.round("value", 0).cast("double").alias("numeric_value"), F.concat(F.lit("v"), F.round("value", 0).cast("long").cast("string")).alias("value_text"),
    )


METRICS = """m AS (SELECT user_id % 50 AS doc_id, event_type AS name, strftime(ts, '%Y-%m') AS time_period, round(value, 0) AS numeric_value, 'v' || CAST(round(value, 0) AS BIGINT) AS value_text FROM events)"""


def dedup_metrics(spark, d) -> DataFrame:
    return reduce.dedup_metrics(_metric_rows(spark, d), ["doc_id"]).select("doc_id", "name", "time_period", "value_text")


DEDUP_METRICS = f"WITH {METRICS} SELECT doc_id, name, time_period, value_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name, time_period ORDER BY length(value_text) DESC, value_text) AS k FROM m) WHERE k = 1"


def metric_conflicts(spark, d) -> DataFrame:
    return reduce.metric_conflicts(_metric_rows(spark, d), ["doc_id"]).select("doc_id", "name", "time_period", "n_values", "low", "high")


METRIC_CONFLICTS = f"WITH {METRICS} SELECT doc_id, name, time_period, count(DISTINCT numeric_value) AS n_values, min(numeric_value) AS low, max(numeric_value) AS high FROM m WHERE numeric_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT numeric_value) > 1"


def escalate_risks(spark, d) -> DataFrame:
    o = t(spark, d, "orders")
    rows = o.select((F.col("o_custkey") % 100).alias("doc_id"), F.col("o_orderstatus").alias("risk_category"), F.concat(F.lit(" Risk  of "), F.lower("o_orderpriority")).alias("text"), F.when(F.col("o_orderkey") % 5 == 0, "high").when(F.col("o_orderkey") % 3 == 0, "low").alias("severity"))
    return reduce.escalate_risks(rows, ["doc_id"]).select("doc_id", "risk_category", "gist", "severity", "n_merged")


ESCALATE_RISKS = """SELECT o_custkey % 100 AS doc_id, o_orderstatus AS risk_category, 'risk of ' || lower(o_orderpriority) AS gist,
  CASE max(CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 0 END) WHEN 2 THEN 'high' WHEN 0 THEN 'low' END AS severity, count(*) AS n_merged FROM orders GROUP BY 1, 2, 3"""


def merge_entities(spark, d) -> DataFrame:
    """Customers of a nation in chains: each shares an alias with the next one of
    its block of eight, so the ends of a chain meet over all that are between."""
    c = t(spark, d, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    alias = lambda k: F.concat(F.lit("Link "), k.cast("string"))
    rows = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("name"), F.when(F.col("k") % 8 == 7, F.array(alias(F.col("k")))).otherwise(F.array(alias(F.col("k")), alias(F.col("k") + 1))).alias("aliases"))
    return reduce.merge_entities(rows, ["doc_id"]).select("doc_id", "name", F.array_join("aliases", ",").alias("aliases"))


MERGE_ENTITIES = """WITH c AS (SELECT c_nationkey AS doc_id, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer),
e AS (SELECT doc_id, k // 8 AS g, c_name AS s FROM c UNION SELECT doc_id, k // 8, 'Link ' || k FROM c UNION SELECT doc_id, k // 8, 'Link ' || (k + 1) FROM c WHERE k % 8 <> 7),
x AS (SELECT doc_id, g, s, row_number() OVER (PARTITION BY doc_id, g ORDER BY length(s) DESC, s DESC) AS n FROM e)
SELECT doc_id, max(CASE WHEN n = 1 THEN s END) AS name, string_agg(s, ',' ORDER BY s) FILTER (n > 1) AS aliases FROM x GROUP BY doc_id, g"""


def enumerate_all(spark, d) -> DataFrame:
    p = t(spark, d, "part")
    rows = p.select((F.col("p_size") % 10).alias("doc_id"), F.col("p_type").alias("text"), F.col("p_brand").alias("chapter_name"))
    return reduce.enumerated(rows).select("doc_id", "gist", "n", F.size("chapters").alias("n_chapters"))


ENUMERATE_ALL = "SELECT p_size % 10 AS doc_id, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS gist, count(*) AS n, CAST(count(DISTINCT p_brand) AS INTEGER) AS n_chapters FROM part GROUP BY 1, 2"


def _tasks(spark, d) -> DataFrame:
    """Twelve tasks for each of some questions, every fourth of no known section."""
    q = t(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), (F.col("c_nationkey") % 5).cast("long").alias("doc_id"))
    each = q.select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("task_no"))
    return each.withColumn("section_name", F.when((F.col("task_no") + F.col("question_id")) % 4 == 0, "nowhere").otherwise(F.concat(F.lit("S"), (F.col("task_no") % 3).cast("string"))))


def _known(spark, d) -> DataFrame:
    return t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.explode(F.array(F.lit("S0"), F.lit("S1"), F.lit("S2"))).alias("section_name"))


def plan_tasks(spark, d) -> DataFrame:
    return planner.valid_tasks(_tasks(spark, d), _known(spark, d)).select("question_id", "doc_id", "task_no", "section_name")


def plan_dropped(spark, d) -> DataFrame:
    return planner.dropped_tasks(_tasks(spark, d), _known(spark, d)).select("question_id", "doc_id", "task_no", "section_name")


PLAN = """SELECT c_custkey AS question_id, CAST(c_nationkey % 5 AS BIGINT) AS doc_id, CAST(k AS INTEGER) AS task_no, CASE WHEN (k + c_custkey) % 4 = 0 THEN 'nowhere' ELSE 'S' || (k % 3) END AS section_name
FROM customer, range(1, 11) AS z(k) WHERE (k + c_custkey) % 4 {} 0"""


def plan_sections(spark, d) -> DataFrame:
    """A question for each brand and type of parts, over the parts of the brand as
    sections of a document."""
    p = t(spark, d, "part")
    questions = p.select(F.concat_ws(" ", "p_brand", "p_type").alias("question_id"), F.col("p_brand").alias("doc_id"), F.col("p_type").alias("question")).distinct()
    sections = p.select(F.col("p_brand").alias("doc_id"), F.concat_ws(" ", "p_type", "p_name").alias("section_name"), F.lit("").alias("summary")).distinct()
    return planner.plan(questions, sections, 3).select("question_id", "doc_id", "task_no", "section_name", "score")


PLAN_SECTIONS = r"""WITH w AS (SELECT DISTINCT p_brand || ' ' || p_type AS q, p_brand AS b, unnest(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS x FROM part WHERE NOT regexp_matches(lower(p_type), '\b(all|entire|contradictions?|executive summary|whole)\b')),
s AS (SELECT DISTINCT b, n, unnest(list_filter(regexp_split_to_array(lower(n), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS x FROM (SELECT p_brand AS b, p_type || ' ' || p_name AS n FROM part)),
c AS (SELECT q, w.b, n, count(DISTINCT w.x) AS score FROM w JOIN s ON w.b = s.b AND w.x = s.x GROUP BY ALL)
SELECT q AS question_id, b AS doc_id, CAST(k AS INTEGER) AS task_no, n AS section_name, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS k FROM c) WHERE k <= 3"""


def routes(spark, d) -> DataFrame:
    """Every message as a question, two thirds of them with cues before it."""
    cues = F.when(F.col("conv_id") % 3 == 0, "Why and how does it compare, explain ").when(F.col("conv_id") % 3 == 1, "Where is the exact page of ").otherwise("")
    q = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.concat(cues, F.coalesce("text", F.lit(""))).alias("question"))
    return planner.route(q).select("question_id", "route", "failover")


ROUTES = r"""WITH q AS (SELECT conv_id * 1000 + turn AS question_id, list_distinct(regexp_split_to_array(lower(CASE conv_id % 3 WHEN 0 THEN 'Why and how does it compare, explain ' WHEN 1 THEN 'Where is the exact page of ' ELSE '' END || coalesce(text, '')), '[^\p{L}]+')) AS w FROM conversations),
r AS (SELECT question_id, len(list_intersect(w, ['why', 'how', 'compare', 'summarize', 'summarise', 'explain', 'contradiction', 'trend', 'overall', 'strategy', 'relationship']))
  > len(list_intersect(w, ['page', 'where', 'find', 'exact', 'quote', 'value', 'number', 'date', 'locate', 'mention'])) AS why FROM q)
SELECT question_id, CASE WHEN why THEN 'reason' ELSE 'lookup' END AS route, CASE WHEN why THEN 'lookup' ELSE 'reason' END AS failover FROM r"""


def skip_existing(spark, d) -> DataFrame:
    """Customers without an order of the status P."""
    stored = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return store.missing_work(t(spark, d, "customer").select("c_custkey", "c_name"), stored, ["c_custkey"])


SKIP_EXISTING = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"


def upsert_merge(spark, d) -> DataFrame:
    """Even customers come anew without their segment, which they keep; ten are new."""
    c = t(spark, d, "customer")
    old = c.where("c_custkey > 10").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0 or c_custkey <= 10").select("c_custkey", F.concat(F.lit("New "), F.col("c_name")).alias("c_name"), F.col("c_nationkey").alias("nation"))
    return store.upsert(old, new, ["c_custkey"])


UPSERT_MERGE = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey <= 10 THEN 'New ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey > 10 THEN c_mktsegment END AS c_mktsegment,
CASE WHEN c_custkey % 2 = 0 OR c_custkey <= 10 THEN c_nationkey END AS nation FROM customer"""


def unique_check(spark, d) -> DataFrame:
    return store.duplicates(t(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


UNIQUE_CHECK = "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def store_scans(spark, d) -> DataFrame:
    """Section index of one document, with the filter and four columns at the scan."""
    rows = t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("section_name"), F.col("lang").alias("chapter_name"), F.array("doc_id").alias("pages"), F.col("n_chars").alias("summary"))
    return store.list_sections(rows, "src0").select("section_name", "chapter_name", F.get("pages", F.lit(0)).alias("page"), "summary")


STORE_SCANS = "SELECT 'S' || doc_id AS section_name, lang AS chapter_name, doc_id AS page, n_chars AS summary FROM documents WHERE source = 'src0'"


def reference_check(spark, d) -> DataFrame:
    rows = t(spark, d, "supplier").select(F.lit(1).alias("doc_id"), F.col("s_suppkey").alias("id"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("entity_ref"))
    named = t(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.lit(1).alias("doc_id"), F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("name"))
    return store.unresolved(rows, named).select("id", "entity_ref")


REFERENCE_CHECK = "SELECT s_suppkey AS id, 'nation_' || s_nationkey AS entity_ref FROM supplier WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_nationkey % 2 = 0)"


def trace_events(spark, d) -> DataFrame:
    """Events as a run's trace: views start calls, clicks end the call of the same
    number, purchases are model results under the last call, errors are bad."""
    e = t(spark, d, "events")
    run = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("seq", F.row_number().over(run)).withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    views = F.sum((F.col("event_type") == "view").cast("int")).over(run)
    kind = F.when(F.col("event_type") == "view", "tool_start").when(F.col("event_type") == "click", "tool_end").when(F.col("event_type") == "purchase", "model_end").when(F.col("event_type") == "signup", "finalize").otherwise("bad")
    spent = F.when(kind == "model_end", F.floor("value").cast("long"))
    return rows.withColumn("views", views).select(
        F.col("user_id").alias("run_id"), "seq", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.when(F.col("k") % 3 == 1, "lookup").when(F.col("k") % 3 == 2, "grep").otherwise("plan_sections").alias("name"),
        F.when(kind.isin("tool_start", "tool_end"), F.concat(F.lit("c"), F.col("k").cast("string"))).alias("call_id"),
        F.when(kind == "tool_start", F.when(F.col("k") > 1, F.array(F.concat(F.lit("c"), (F.col("k") - 1).cast("string")))).otherwise(F.array().cast("array<string>"))).when(F.col("views") >= 2, F.array(F.concat(F.lit("c"), (F.col("views") - 1).cast("string")), F.concat(F.lit("c"), F.col("views").cast("string")))).when(F.col("views") == 1, F.array(F.lit("c1"))).otherwise(F.array().cast("array<string>")).alias("parent_ids"),
        spent.alias("input_tokens"), F.when(kind == "model_end", F.lit(1).cast("long")).alias("output_tokens"), (spent + 1).alias("total_tokens"),
        F.when(kind == "finalize", F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("answer"),
    )


TRACE = """r AS (SELECT *, row_number() OVER w AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS views
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
call AS (SELECT v.user_id AS run_id, v.k, v.seq, v.ts AS started, c.seq AS end_seq, c.ts AS ended, CASE v.k % 3 WHEN 1 THEN 'lookup' WHEN 2 THEN 'grep' ELSE 'plan_sections' END AS name
  FROM r v LEFT JOIN r c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.k = v.k AND c.seq > v.seq WHERE v.event_type = 'view'),
sc AS (SELECT *, CASE name WHEN 'lookup' THEN 'lookup_agent' ELSE 'section_planner' END AS kind, CASE name WHEN 'lookup' THEN 'lookup_agent_call_' ELSE 'plan_sections_call_' END || row_number() OVER (PARTITION BY run_id, name ORDER BY seq) AS scope_id FROM call WHERE name <> 'grep'),
usage AS (SELECT p.user_id AS run_id, coalesce(CASE WHEN a.scope_id IS NOT NULL AND (a.end_seq IS NULL OR a.end_seq > p.seq) THEN a.scope_id END, CASE WHEN b.scope_id IS NOT NULL AND (b.end_seq IS NULL OR b.end_seq > p.seq) THEN b.scope_id END, 'supervisor') AS scope_id, CAST(floor(p.value) AS BIGINT) AS i
  FROM r p LEFT JOIN sc a ON a.run_id = p.user_id AND a.k = p.views LEFT JOIN sc b ON b.run_id = p.user_id AND b.k = p.views - 1 WHERE p.event_type = 'purchase'),
su AS (SELECT run_id, scope_id, kind FROM sc UNION ALL SELECT DISTINCT user_id, 'supervisor', 'supervisor' FROM r),
tot AS (SELECT su.run_id, su.scope_id, su.kind, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, count(i) AS output_tokens, CAST(coalesce(sum(i), 0) + count(i) AS BIGINT) AS total_tokens, count(i) AS llm_calls
  FROM su LEFT JOIN usage u ON u.run_id = su.run_id AND u.scope_id = su.scope_id GROUP BY ALL)"""


def scope_attribution(spark, d) -> DataFrame:
    return traces.scope_usage(trace_events(spark, d))


def trace_totals(spark, d) -> DataFrame:
    return traces.run_totals(traces.scope_usage(trace_events(spark, d)))


def trace_rollup(spark, d) -> DataFrame:
    return traces.usage_rollup(traces.scope_usage(trace_events(spark, d)))


def tool_counts(spark, d) -> DataFrame:
    return traces.tool_counts(trace_events(spark, d))


def tool_durations(spark, d) -> DataFrame:
    return traces.calls(trace_events(spark, d)).select("run_id", "call_id", "name", "end_seq", "duration_seconds")


def final_answers(spark, d) -> DataFrame:
    return traces.final_answers(trace_events(spark, d), "none")


def scope_tree(spark, d) -> DataFrame:
    return traces.scope_tree(traces.scope_parents(trace_events(spark, d))).select("run_id", "scope_id", "kind", "depth", "place")


def stream_scopes(spark, d) -> DataFrame:
    """The events as a stream of many micro-batches, out of order, a sixth of them
    twice; of each scope the latest update."""
    events, folder = trace_events(spark, d), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    again = events.unionByName(events.where(F.hash("run_id", "seq") % 6 == 0))
    again.repartition(6, F.rand(7)).write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")

    def keep(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    updates = scopes.scope_updates(stream, late="36500 days")
    updates.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/updates")
    columns = ["kind", "input_tokens", "output_tokens", "total_tokens", "llm_calls"]
    last = found.groupBy("run_id", "scope_id").agg(F.max_by(F.struct(*columns), "batch").alias("x"))
    return last.select("run_id", "scope_id", "x.*")


SCOPES = f"WITH {TRACE} SELECT * FROM tot"
TOTALS = f"WITH {TRACE} SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(llm_calls) AS BIGINT) AS llm_calls, count(*) AS n_scopes FROM tot GROUP BY run_id"
ROLLUP = f"WITH {TRACE} SELECT run_id, kind, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(llm_calls) AS BIGINT) AS llm_calls, CAST(grouping_id(run_id, kind) AS BIGINT) AS level FROM tot GROUP BY ROLLUP (run_id, kind)"
TOOL_COUNTS = f"WITH {TRACE} SELECT run_id, name, count(*) AS n_calls FROM call GROUP BY ALL"
TOOL_DURATIONS = f"WITH {TRACE} SELECT run_id, 'c' || k AS call_id, name, CAST(end_seq AS INTEGER) AS end_seq, round((epoch_us(ended) - epoch_us(started)) / 1e6, 3) AS duration_seconds FROM call"
FINAL = "SELECT user_id AS run_id, coalesce('answer ' || arg_max(event_id, (ts, event_id)) FILTER (event_type = 'signup'), 'none') AS final_answer FROM events GROUP BY user_id"
TREE = f"""WITH RECURSIVE {TRACE},
par AS (SELECT s.run_id, s.scope_id, s.kind, s.seq, CASE WHEN q.scope_id IS NOT NULL AND (q.end_seq IS NULL OR q.end_seq > s.seq) THEN q.scope_id ELSE 'supervisor' END AS parent,
  row_number() OVER (PARTITION BY s.run_id ORDER BY s.seq) AS o FROM sc s LEFT JOIN sc q ON q.run_id = s.run_id AND q.k = s.k - 1),
t AS (SELECT DISTINCT user_id AS run_id, 'supervisor' AS scope_id, 'supervisor' AS kind, 0 AS depth, lpad('0', 9, '0') AS path FROM r
  UNION ALL SELECT p.run_id, p.scope_id, p.kind, t.depth + 1, t.path || '/' || lpad(CAST(p.o AS VARCHAR), 9, '0') FROM t JOIN par p ON p.run_id = t.run_id AND p.parent = t.scope_id)
SELECT run_id, scope_id, kind, depth, CAST(row_number() OVER (PARTITION BY run_id ORDER BY path) AS INTEGER) AS place FROM t"""


def payload_parse(spark, d) -> DataFrame:
    """Every second message as a payload, the others plain; settings fill in."""
    c = t(spark, d, "conversations")
    body = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("question"), F.concat(F.lit("d"), F.col("turn").cast("string")).alias("document_id")))).otherwise(F.col("text"))
    found = payloads.run_inputs(c.withColumn("text", body), {"document_id": "default"})
    return found.where("role = 'user'").select("conv_id", "turn", "question", "document_id", "is_payload")


PAYLOAD_PARSE = "SELECT conv_id, turn, text AS question, CASE WHEN conv_id % 2 = 0 THEN 'd' || turn ELSE 'default' END AS document_id, conv_id % 2 = 0 AS is_payload FROM conversations WHERE role = 'user'"


def channel_concat(spark, d) -> DataFrame:
    """Channels of parallel branches put together (G1), and pages united."""
    a = t(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("v"))
    b = t(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("v"))
    both = reduce.channels(a.withColumn("of", F.lit("supplier")), b)
    return both.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_distinct"), F.count("of").alias("n_suppliers"))


CHANNEL_CONCAT = "SELECT key, count(*) AS n, count(DISTINCT v) AS n_distinct, count(f) AS n_suppliers FROM (SELECT s_nationkey AS key, s_suppkey AS v, 'supplier' AS f FROM supplier UNION ALL SELECT c_nationkey, c_custkey, NULL FROM customer) GROUP BY key"


def previews(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", X.preview("text", 100).alias("preview"), X.thousands("n_chars").alias("shown"), X.segment_id("doc_id").alias("seg_id"))


PREVIEWS = "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substring(text, 1, 100) || '… (truncated, ' || (length(text) - 100) || ' more chars)' END AS preview, format('{:,}', n_chars) AS shown, printf('s_%03d', doc_id) AS seg_id FROM documents"

#: name: (query, SQL or None)
CATALOGUE = {
    "page_split": (page_split, PAGE_SPLIT),
    "page_map_first": (page_map_first, PAGE_MAP_FIRST),
    "page_map_all": (page_map_all, PAGE_MAP_ALL),
    "list_pages": (list_pages, LIST_PAGES),
    "page_counts": (page_counts, PAGE_COUNTS),
    "first_n_pages": (first_n_pages, FIRST_N_PAGES),
    "grep_literal": (grep_literal, GREP_LITERAL),
    "grep_regex": (grep_regex, GREP_REGEX),
    "grep_indexed": (grep_indexed, GREP_INDEXED),
    "grep_indexed_regex": (grep_indexed_regex, GREP_INDEXED_REGEX),
    "kept_pages": (kept_pages, LIST_PAGES),
    "grep_page_filter": (grep_page_filter, GREP_PAGE_FILTER),
    "grep_unmapped_filter": (grep_unmapped_filter, GREP_UNMAPPED),
    "grep_section": (grep_section, GREP_SECTION),
    "grep_many": (grep_many, GREP_MANY),
    "verify_quotes": (verify_quotes, VERIFY_QUOTES),
    "page_text": (page_text, PAGE_TEXT),
    "clean_images": (clean_images, CLEAN_IMAGES),
    "toc_extract": (toc_extract, TOC_EXTRACT),
    "toc_ranges": (toc_ranges, TOC_RANGES),
    "section_pages": (section_pages, SECTION_PAGES),
    "section_text": (section_text, SECTION_TEXT),
    "segments_fixed": (segments_fixed, SEGMENTS_FIXED),
    "segments_recursive": (segments_recursive, None),
    "reduce_sections": (reduce_sections, REDUCE_SECTIONS),
    "reduce_chapters": (reduce_chapters, REDUCE_CHAPTERS),
    "topics_union": (topics_union, TOPICS_UNION),
    "dedup_metrics": (dedup_metrics, DEDUP_METRICS),
    "metric_conflicts": (metric_conflicts, METRIC_CONFLICTS),
    "escalate_risks": (escalate_risks, ESCALATE_RISKS),
    "merge_entities": (merge_entities, MERGE_ENTITIES),
    "enumerate_all": (enumerate_all, ENUMERATE_ALL),
    "plan_tasks": (plan_tasks, PLAN.format("<>")),
    "plan_dropped": (plan_dropped, PLAN.format("=")),
    "plan_sections": (plan_sections, PLAN_SECTIONS),
    "routes": (routes, ROUTES),
    "skip_existing": (skip_existing, SKIP_EXISTING),
    "upsert_merge": (upsert_merge, UPSERT_MERGE),
    "unique_check": (unique_check, UNIQUE_CHECK),
    "store_scans": (store_scans, STORE_SCANS),
    "reference_check": (reference_check, REFERENCE_CHECK),
    "scope_attribution": (scope_attribution, SCOPES),
    "trace_totals": (trace_totals, TOTALS),
    "trace_rollup": (trace_rollup, ROLLUP),
    "tool_counts": (tool_counts, TOOL_COUNTS),
    "tool_durations": (tool_durations, TOOL_DURATIONS),
    "final_answers": (final_answers, FINAL),
    "scope_tree": (scope_tree, TREE),
    "stream_scopes": (stream_scopes, SCOPES),
    "payload_parse": (payload_parse, PAYLOAD_PARSE),
    "channel_concat": (channel_concat, CHANNEL_CONCAT),
    "previews": (previews, PREVIEWS),
}
