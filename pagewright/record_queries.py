"""Further registered queries: records, findings, items, answers, texts, files.

Like ``catalogue``, each has DuckDB SQL that computes the same rows from the
tables by other means."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalogue as base
from . import retry
from .config import SETTINGS, Settings
from .functions import text as X
from .lineage import cut, shared_folder
from .operators import clean, grep, pages, payloads, reduce, segments, store, traces
from .plans import answers
from .sources import corpus

t = corpus.tables


def _joined(c: Column | str) -> Column:
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c, ",")


# ---------------------------------------------------------------- records


def _chapters(spark, d) -> DataFrame:
    """Orders as chapter records of their customer."""
    o = t(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("chapter_name"), F.array("o_orderstatus").alias("section_names"),
        F.array((F.col("o_orderkey") % 7).cast("int"), (F.col("o_orderkey") % 5).cast("int")).alias("pages"), F.lower("o_orderpriority").alias("summary"),
    )


CHAPTERS = "ch AS (SELECT o_custkey AS doc_id, 'C' || o_orderkey AS chapter_name, o_orderstatus AS section, (o_orderkey % 7) || ',' || (o_orderkey % 5) AS pages, lower(o_orderpriority) AS summary, o_orderkey, o_orderstatus FROM orders)"


def chapter_scan(spark, d) -> DataFrame:
    """A10: the whole chapter records of one document."""
    return store.list_chapters(_chapters(spark, d), 7).withColumn("pages", _joined("pages")).withColumn("section_names", _joined("section_names"))


CHAPTER_SCAN = f"WITH {CHAPTERS} SELECT doc_id, chapter_name, section AS section_names, pages, summary FROM ch WHERE doc_id = 7"


def chapter_summaries(spark, d) -> DataFrame:
    """Four fields of them."""
    return store.list_chapter_summaries(_chapters(spark, d), 7).withColumn("pages", _joined("pages")).withColumn("section_names", _joined("section_names"))


CHAPTER_SUMMARIES = f"WITH {CHAPTERS} SELECT chapter_name, section AS section_names, pages, summary FROM ch WHERE doc_id = 7"


def record_reads(spark, d) -> DataFrame:
    """Point reads of a section, a chapter, a segment, and of a key that isn't there."""
    parts = t(spark, d, "part").select((F.col("p_size") % 10).alias("doc_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    found = {
        "section": store.get_record(parts, id=5).select("name"),
        "chapter": store.get_record(_chapters(spark, d), chapter_name="C5").select("summary"),
        "segment": store.get_record(t(spark, d, "orders"), o_orderkey=9).select("o_orderstatus"),
        "none": store.get_record(parts, id=-1).select("name"),
    }
    return fold(DataFrame.union, [df.select(F.lit(what).alias("what"), F.col(df.columns[0]).alias("name")) for what, df in found.items()])


RECORD_READS = "SELECT 'section' AS what, p_name AS name FROM part WHERE p_partkey = 5 UNION ALL SELECT 'chapter', lower(o_orderpriority) FROM orders WHERE o_orderkey = 5 UNION ALL SELECT 'segment', o_orderstatus FROM orders WHERE o_orderkey = 9"


def segments_meta(spark, d) -> DataFrame:
    """Segments of a section without their text."""
    rows = t(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("doc_id"), F.col("l_returnflag").alias("section_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_no"), F.col("l_linestatus").alias("chapter_name"), F.array("l_suppkey").alias("pages"), F.col("l_linenumber").alias("token_count"), F.lit("text").alias("text"))
    found = store.segments_meta(rows.withColumn("seg_id", X.segment_id("seg_no")), 3, "R")
    return found.withColumn("pages", _joined("pages"))


SEGMENTS_META = "SELECT printf('s_%03d', l_orderkey * 10 + l_linenumber) AS seg_id, l_returnflag AS section_name, l_linestatus AS chapter_name, l_suppkey::VARCHAR AS pages, l_linenumber AS token_count FROM lineitem WHERE l_partkey % 50 = 3 AND l_returnflag = 'R'"


def planner_catalogue(spark, d) -> DataFrame:
    """A document's sections as one compact JSON array."""
    rows = _chapters(spark, d).select("doc_id", F.col("chapter_name").alias("section_name"), F.lit("é").alias("chapter_name"), "pages", "summary")
    return store.catalogue_json(rows)


PLANNER_CATALOGUE = """SELECT doc_id, '[' || string_agg('{"section_name":"' || s || '","chapter_name":"é","pages":[' || a || ',' || b || '],"summary":"' || m || '"}', ',' ORDER BY least(a, b), s) || ']' AS catalogue
FROM (SELECT o_custkey AS doc_id, 'C' || o_orderkey AS s, o_orderkey % 7 AS a, o_orderkey % 5 AS b, lower(o_orderpriority) AS m FROM orders) GROUP BY doc_id"""


def work_progress(spark, d) -> DataFrame:
    """Customers with and without an order under way, by nation."""
    work = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    return store.progress(work, t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], ["c_nationkey"])


WORK_PROGRESS = "SELECT c_nationkey, count(*) FILTER (h) AS done, count(*) FILTER (NOT h) AS missing, count(*) AS total FROM (SELECT c_nationkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS h FROM customer) GROUP BY 1"


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved_records(spark, d) -> DataFrame:
    """Two versions saved after each other; the second keeps what it doesn't set."""
    c, path = t(spark, d, "customer"), _scratch(spark, "records")
    store.save(c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_mktsegment"), path, ["c_custkey"])
    store.save(c.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name")), path, ["c_custkey"])
    return store.load(spark, path)


SAVED_RECORDS = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"


def stored_reads(spark, d) -> DataFrame:
    """Three saves of customers by two keys, of which the second changes
    some; the records of three keys, each read from its bucket."""
    c, path, keys = t(spark, d, "customer").withColumn("doc_id", F.col("c_custkey") % 7), _scratch(spark, "store"), ["doc_id", "c_custkey"]
    store.save(c.select(*keys, "c_name", "c_mktsegment"), path, keys, buckets=16)
    store.save(c.where("c_custkey % 10 = 1").select(*keys, F.upper("c_name").alias("c_name"), "c_nationkey"), path, keys)
    store.save(c.where("c_custkey = 2").select(*keys, F.lit("gone").alias("c_mktsegment")), path, keys)
    return fold(DataFrame.unionByName, [store.read_key(spark, path, doc_id=k % 7, c_custkey=k) for k in (2, 11, 12, 10**9)])


STORED_READS = """SELECT c_custkey % 7 AS doc_id, c_custkey, CASE WHEN c_custkey = 11 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey = 2 THEN 'gone' ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN c_custkey = 11 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_custkey IN (2, 11, 12)"""


def segment_files(spark, d) -> DataFrame:
    """Segments written, one JSON object a document, and read again."""
    path = _scratch(spark, "segments")
    rows = t(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("doc_id"), F.col("o_orderkey").alias("seg_no"), X.segment_id("o_orderkey").alias("seg_id"), F.lit("S").alias("section_name"), F.lit("C").alias("chapter_name"), F.array((F.col("o_orderkey") % 9).cast("int")).alias("pages"), F.lit(1).alias("token_count"), F.col("o_orderpriority").alias("text"))
    corpus.write_segments(rows, path)
    return corpus.read_segments(spark, path, one_a_line=True).withColumn("pages", _joined("pages")).drop("token_count")


SEGMENT_FILES = "SELECT 'd' || o_custkey AS doc_id, printf('s_%03d', o_orderkey) AS seg_id, 'S' AS section_name, 'C' AS chapter_name, (o_orderkey % 9)::VARCHAR AS pages, o_orderpriority AS text FROM orders"


def cached_documents(spark, d) -> DataFrame:
    """A4, A5: cached markdown is read, the rest made anew."""
    docs, path = base._docs(spark, d), _scratch(spark, "markdown")
    corpus.write_markdown(docs.where("doc_id % 2 = 0"), path)
    whole = corpus.cached_or_new(spark.read.parquet(path).withColumn("made", F.lit(False)), docs, lambda rest: rest.withColumn("made", F.lit(True)))
    return whole.select("doc_id", "made", pages.page_count("text").cast("int").alias("page_count"))


CACHED_DOCUMENTS = f"WITH {base.LINES} SELECT doc_id, doc_id % 2 <> 0 AS made, CAST(count(*) AS INTEGER) AS page_count FROM page GROUP BY doc_id"


def trace_files(spark, d) -> DataFrame:
    """Traces added to a folder of JSON files and read again."""
    path = _scratch(spark, "traces")
    rows = t(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n_events"))
    told = corpus.write_traces(rows, path) and not corpus.write_traces(rows, "nowhere://x")
    return corpus.read_traces(spark, path, one_a_line=True).withColumn("told", F.lit(told))


TRACE_FILES = "SELECT user_id AS run_id, count(*) AS n_events, true AS told FROM events GROUP BY user_id"


# ---------------------------------------------------------------- findings


def dedup_claims(spark, d) -> DataFrame:
    """D13."""
    rows = t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("doc_id"), F.concat(F.lit(" Claim  "), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))).alias("text"), F.col("l_linestatus").alias("polarity"), F.date_format("l_shipdate", "yyyy").alias("temporal_scope"), F.concat(F.repeat(F.lit("q"), F.col("l_linenumber")), (F.col("l_orderkey") % 10).cast("string")).alias("supporting_quote"))
    return reduce.dedup_claims(rows, ["doc_id"])


DEDUP_CLAIMS = """WITH r AS (SELECT l_suppkey % 20 AS doc_id, ' Claim  ' || CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AS text, l_linestatus AS polarity, strftime(l_shipdate, '%Y') AS temporal_scope, repeat('q', l_linenumber) || (l_orderkey % 10) AS supporting_quote FROM lineitem)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, polarity, temporal_scope, lower(text) ORDER BY length(supporting_quote) DESC, supporting_quote, text) AS k FROM r) WHERE k = 1"""


def dedup_decisions(spark, d) -> DataFrame:
    """D14."""
    rows = t(spark, d, "part").select((F.col("p_size") % 10).alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(F.col("p_type")).alias("text"), F.col("p_brand").alias("decision_type"))
    return reduce.dedup_decisions(rows, ["doc_id"])


DEDUP_DECISIONS = """WITH r AS (SELECT p_size % 10 AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_type) ELSE p_type END AS text, p_brand AS decision_type FROM part)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(text)) ORDER BY text, decision_type) AS k FROM r) WHERE k = 1"""


def merge_contradictions(spark, d) -> DataFrame:
    """Statements and quotes of the same description united."""
    o = t(spark, d, "orders")
    rows = o.select((F.col("o_custkey") % 20).alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("description"), F.array("o_orderstatus").alias("statements"), F.array((F.col("o_orderkey") % 3).cast("string")).alias("supporting_quotes"))
    found = reduce.merge_contradictions(rows, ["doc_id"])
    return found.select("doc_id", F.lower("description").alias("description"), _joined("statements").alias("statements"), _joined("supporting_quotes").alias("supporting_quotes"))


MERGE_CONTRADICTIONS = """WITH p AS (SELECT DISTINCT o_custkey % 20 AS doc_id, lower(o_orderpriority) AS description, o_orderstatus AS s, (o_orderkey % 3)::VARCHAR AS q FROM orders)
SELECT doc_id, description, string_agg(s, ',' ORDER BY s, q) AS statements, string_agg(q, ',' ORDER BY s, q) AS supporting_quotes FROM p GROUP BY ALL"""


def _spoken(spark, d) -> DataFrame:
    """Analyses with more distinct quotes than a record keeps."""
    rows = base._analyses(spark, d).withColumn("doc_id", F.col("seg_no") % 40)
    return rows.withColumn("salient_quotes", F.array(F.concat(F.lit("Quote "), (F.col("seg_no") % 700).cast("string")))).withColumn("notable_other", F.array(F.concat(F.lit("Note "), (F.col("seg_no") % 3).cast("string")), F.lit("note  0")))


SPOKEN = """s AS (SELECT doc_id AS seg_no, doc_id % 40 AS doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'S' || (doc_id % 3) END AS section_name, n_chars,
  CASE WHEN toxic = 1 THEN 'negative' WHEN n_chars % 2 = 0 THEN 'positive' ELSE 'neutral' END AS s, CASE WHEN doc_id % 6 = 0 THEN 1000000000 ELSE least(doc_id % 9, doc_id % 5) END AS least_page FROM documents LEFT JOIN labels USING (doc_id)),
w AS (SELECT doc_id, section_name, seg_no * 2 AS o, 'T' AS kind, 'Topic  ' || (n_chars % 4) AS x FROM s UNION ALL SELECT doc_id, section_name, seg_no * 2 + 1, 'T', 'topic ' || (n_chars % 3) FROM s
  UNION ALL SELECT doc_id, section_name, seg_no, 'Q', 'Quote ' || (seg_no % 700) FROM s
  UNION ALL SELECT doc_id, section_name, seg_no * 2, 'N', 'Note ' || (seg_no % 3) FROM s UNION ALL SELECT doc_id, section_name, seg_no * 2 + 1, 'N', 'note  0' FROM s),
u AS (SELECT doc_id, section_name, kind, min(o) AS o, arg_min(x, o) AS x FROM w GROUP BY doc_id, section_name, kind, regexp_replace(lower(x), '\\s+', ' ', 'g')),
v AS (SELECT doc_id, section_name, string_agg(x, ',' ORDER BY o) FILTER (kind = 'T') AS topics, array_to_string((list(x ORDER BY o) FILTER (kind = 'Q'))[1:10], ',') AS salient_quotes,
  string_agg(x, ',' ORDER BY o) FILTER (kind = 'N') AS notable_other FROM u GROUP BY doc_id, section_name)"""


def section_texts(spark, d) -> DataFrame:
    """Summary, topics, quotes and notable texts of section records."""
    found = reduce.reduce_sections(_spoken(spark, d))
    return found.select("doc_id", "section_name", "summary", *[_joined(c).alias(c) for c in reduce.TEXTS])


SECTION_TEXTS = f"""WITH {SPOKEN} SELECT v.*, m.summary FROM v JOIN (SELECT doc_id, section_name, string_agg('Doc ' || seg_no, ' ' ORDER BY seg_no) AS summary FROM s GROUP BY ALL) m ON m.doc_id = v.doc_id AND m.section_name = v.section_name"""


def chapter_texts(spark, d) -> DataFrame:
    """D9, D10, D17 a level up: summary, sentiment and number of topics and quotes of chapters."""
    sections = reduce.reduce_sections(_spoken(spark, d)).withColumn("chapter_name", F.when(F.col("section_name") == "S1", "one").otherwise("two"))
    found = reduce.reduce_chapters(sections)
    return found.select("doc_id", "chapter_name", "summary", "sentiment", F.size("topics").alias("n_topics"), F.size("salient_quotes").alias("n_quotes"), F.size("notable_other").alias("n_notes"))


COUNTS = {k: f"count(*) FILTER (sent = '{k}')" for k in ("positive", "negative", "neutral", "mixed")}
MOST = " ".join(f"WHEN {n} > greatest({', '.join(m for m in COUNTS.values() if m != n)}) THEN '{k}'" for k, n in COUNTS.items())
SENTIMENT_OF_SECTIONS = f"CASE WHEN {COUNTS['positive']} > 0 AND {COUNTS['negative']} > 0 THEN 'mixed' {MOST} ELSE 'neutral' END"
CHAPTER_TEXTS = f"""WITH {SPOKEN},
r AS (SELECT doc_id, section_name, CASE WHEN section_name = 'S1' THEN 'one' ELSE 'two' END AS chapter_name, string_agg('Doc ' || seg_no, ' ' ORDER BY seg_no) AS summary, min(least_page) AS p, {base.SENTIMENT} AS sent FROM s GROUP BY ALL),
q AS (SELECT doc_id, CASE WHEN section_name = 'S1' THEN 'one' ELSE 'two' END AS chapter_name, kind, count(DISTINCT regexp_replace(lower(x), '\\s+', ' ', 'g')) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, section_name, kind ORDER BY o) AS k FROM u) WHERE kind <> 'Q' OR k <= 10 GROUP BY ALL),
c AS (SELECT doc_id, chapter_name, string_agg(summary, ' ' ORDER BY p, section_name) AS summary, {SENTIMENT_OF_SECTIONS} AS sentiment FROM r GROUP BY ALL)
SELECT c.*, CAST(max(n) FILTER (kind = 'T') AS INTEGER) AS n_topics, CAST(least(max(n) FILTER (kind = 'Q'), 10) AS INTEGER) AS n_quotes, CAST(max(n) FILTER (kind = 'N') AS INTEGER) AS n_notes
FROM c JOIN q ON q.doc_id = c.doc_id AND q.chapter_name = c.chapter_name GROUP BY ALL"""


def unconfirmed_records(spark, d) -> DataFrame:
    """Records with levels out of the schema, levels as JSON lists repaired first."""
    rows = t(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 0, '["low"]').when(F.col("doc_id") % 4 == 1, "LOW").when(F.col("doc_id") % 4 == 2, "high").alias("raw"),
        F.when(F.col("doc_id") % 3 == 0, "mixed").when(F.col("doc_id") % 3 == 1, "glad").alias("sentiment"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("summary"),
    )
    repaired = rows.withColumn("ocr_confidence", F.coalesce(F.get(X.decoded_list("raw"), F.lit(0)), "raw"))
    return reduce.unconfirmed(repaired).select("doc_id", "ocr_confidence", _joined("errors").alias("errors"))


UNCONFIRMED_RECORDS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'LOW' WHEN 2 THEN 'high' END AS ocr_confidence,
  concat_ws(',', CASE WHEN doc_id % 4 IN (1, 3) THEN 'ocr_confidence' END, CASE WHEN doc_id % 3 <> 0 THEN 'sentiment' END, CASE WHEN doc_id % 5 = 0 OR source IS NULL THEN 'summary' END) AS errors FROM documents"""


def error_digests(spark, d) -> DataFrame:
    """F8: the first three errors and how many more."""
    rows = t(spark, d, "customer").select("c_custkey", F.transform(F.expr("sequence(1, int(c_custkey % 6) + 1)"), lambda n: F.concat(F.lit("e"), n.cast("string"))).alias("errors"))
    return rows.select("c_custkey", reduce.error_digest("errors").alias("digest"))


ERROR_DIGESTS = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'e1' WHEN 1 THEN 'e1; e2' WHEN 2 THEN 'e1; e2; e3' ELSE 'e1; e2; e3 (+' || (c_custkey % 6 - 2) || ' more)' END AS digest FROM customer"


# ---------------------------------------------------------------- converted items


def item_footers(spark, d) -> DataFrame:
    """Numbers of footers of every form."""
    n = F.col("o_orderkey").cast("string")
    forms = [n, F.concat(F.lit("Page "), n, F.lit(" of 9")), F.concat(F.lit("Report | "), n, F.lit(" | x")), F.concat(F.lit("sum 2024 "), n), F.concat(n, F.lit(" March")), F.lit("none"), F.concat(F.lit("  "), n, F.lit("\t"))]
    text = fold(lambda out, x: out.when(F.col("o_orderkey") % len(forms) == x[0], x[1]), list(enumerate(forms))[1:], F.when(F.col("o_orderkey") % len(forms) == 0, forms[0]))
    return t(spark, d, "orders").select("o_orderkey", pages.item_footer(text).alias("number"))


ITEM_FOOTERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 5 AND o_orderkey BETWEEN 1 AND 9999 THEN CAST(o_orderkey AS INTEGER) END AS number FROM orders"


def _items(spark, d) -> DataFrame:
    """Six items on each of two pages of a part; page 2 has no footer with a number."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("i")) for i, k in enumerate(("header", "heading", "list", "code", "text", "footer"))])
    each = t(spark, d, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no")).withColumn("x", F.explode(kinds))
    rows = each.select(F.col("p_partkey").alias("doc_id"), "page_no", (F.col("page_no") * 10 + F.col("x.i")).alias("seq"), F.col("x.kind").alias("kind"), (F.col("p_size") % 3 + 1).alias("level"), "p_size")
    text = F.when((F.col("kind") == "footer") & (F.col("page_no") == 1), F.concat(F.lit("Page "), (F.col("p_size") + 100).cast("string"))).otherwise(F.concat("kind", F.lit("-")))
    return rows.withColumn("text", text)


def item_pages(spark, d) -> DataFrame:
    """Page labels overridden by the numbers of footers."""
    labels = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page_no")).withColumn("label", F.concat(F.lit("l"), F.col("page_no").cast("string")))
    return pages.item_pages(_items(spark, d), labels.where("page_no <> 1 or doc_id % 2 = 0"))


ITEM_PAGES = "SELECT p_partkey AS doc_id, CAST(k AS INTEGER) AS page_no, CASE WHEN k = 1 THEN (p_size + 100)::VARCHAR ELSE 'l' || k END AS label FROM part, range(1, 4) AS z(k)"


def rendered_items(spark, d) -> DataFrame:
    """Pages rendered from items."""
    return pages.rendered_items(_items(spark, d))


RENDERED_ITEMS = """SELECT p_partkey AS doc_id, CAST(k AS INTEGER) AS page_no, repeat('#', p_size % 3 + 1) || ' heading-' || chr(10) || chr(10) || '- list-' || chr(10) || chr(10) || '```' || chr(10) || 'code-' || chr(10) || '```' || chr(10) || chr(10) || 'text-' AS text FROM part, range(1, 3) AS z(k)"""


# ---------------------------------------------------------------- answers

TERMS = ("that", "tion", "with", "this", "from")
HITS = "len(list_intersect(list_distinct(regexp_split_to_array(lower(s), '[^\\p{L}\\p{N}]+')), ['that', 'tion', 'with', 'this', 'from']))"


def _asked(spark, d, question: str = "that tion, with this from") -> DataFrame:
    return t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("question_id"), "doc_id", F.lit(question).alias("question"))


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("question_id", *more, "printed_page", "physical_page", "line", "score")


def lookup_answers(spark, d) -> DataFrame:
    """The best lines of each document for a question; every third question names pages."""
    asked = _asked(spark, d).withColumn("pages_filter", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(3))))
    return _shown(answers.lookup(asked, base._pages(spark, d), 5))


EVIDENCE = f"h AS (SELECT doc_id, printed, p, line, {HITS} AS score FROM pg WHERE s <> '')"
BEST = "SELECT {keys} doc_id AS question_id, printed AS printed_page, p AS physical_page, line, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id {part} ORDER BY score DESC, line) AS k FROM {source} WHERE score > 0 {where}) WHERE k <= {limit}"
LOOKUP_ANSWERS = f"WITH {base.LINES}, {EVIDENCE} " + BEST.format(keys="", part="", source="h", where="AND (doc_id % 3 <> 0 OR printed IN (1, 3))", limit=5)


def section_answers(spark, d) -> DataFrame:
    """The best lines of each section; a section that isn't there gives none."""
    sections = cut(segments.section_scopes(base._docs(spark, d), base._toc(spark, d)))
    known = sections.select(F.col("doc_id").alias("question_id"), "doc_id", "section_name", F.lit("that tion with this from").alias("sub_query"))
    lost = known.select("question_id", "doc_id").distinct().select("*", F.lit("nowhere").alias("section_name"), F.lit("that").alias("sub_query"))
    return _shown(answers.section_workers(known.unionByName(lost), base._pages(spark, d), sections, 2), "section_name")


SECTION_ANSWERS = f"WITH {base.TOC}, {EVIDENCE}, sh AS (SELECT DISTINCT sec.section_name, h.* FROM sec JOIN h ON h.doc_id = sec.doc_id AND list_contains(sec.pages, h.printed) WHERE text <> '') " + BEST.format(keys="section_name,", part=", section_name", source="sh", where="", limit=2)


def document_answers(spark, d) -> DataFrame:
    """Chapters that share terms with a question; all for a question about the whole."""
    asked = t(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, "is it urgent or high medium").otherwise("list all of them").alias("question"))
    return answers.document_agent(asked, _chapters(spark, d)).select("question_id", "chapter_name", "score")


DOCUMENT_ANSWERS = f"""WITH {CHAPTERS} SELECT doc_id AS question_id, chapter_name, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE len(list_intersect(regexp_split_to_array(summary, '[^a-z0-9]+'), ['urgent', 'high', 'medium'])) END AS score
FROM ch JOIN customer ON c_custkey = doc_id WHERE doc_id % 2 = 1 OR regexp_matches(summary, 'urgent|high|medium')"""


def routed_answers(spark, d) -> DataFrame:
    """Evidence by each question's route, or by the other if that finds nothing."""
    asked = _asked(spark, d).withColumn("question", F.when(F.col("doc_id") % 2 == 0, "why and how: that tion with this from").otherwise("where: that tion with this from"))
    sections = segments.section_scopes(base._docs(spark, d), base._toc(spark, d)).where("section_name = 'Section 1'").withColumn("summary", F.lit("tion"))
    found = answers.answers(asked, base._pages(spark, d), sections)
    return _shown(found, "route")


ROUTED_ANSWERS = f"""WITH {base.TOC}, {EVIDENCE},
lk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS k FROM h WHERE score > 0) WHERE k <= 20),
rs AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY score DESC, line) AS k FROM h JOIN sec ON h.doc_id = sec.doc_id AND list_contains(sec.pages, h.printed) WHERE score > 0 AND section_name = 'Section 1' AND text <> '') WHERE k <= 20),
b AS (SELECT *, 'lookup' AS via FROM lk UNION ALL SELECT *, 'reason' FROM rs),
r AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'reason' ELSE 'lookup' END AS route FROM b),
f AS (SELECT *, max(CASE WHEN via = route THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS hit FROM r)
SELECT doc_id AS question_id, via AS route, printed AS printed_page, p AS physical_page, line, score FROM f WHERE via = route OR hit = 0"""


def worker_filters(spark, d) -> DataFrame:
    """A worker's own pages, the pages it was sent with, or all."""
    found = base._pages(spark, d)
    cases = {"hint": (None, [1]), "all": ([], [1]), "own": ([2], [1])}
    return fold(DataFrame.unionByName, [grep.grep(found, "th", grep.worker_filter(*c), limit=2).select(F.lit(name).alias("filter"), "doc_id", "printed_page", "line") for name, c in cases.items()])


WORKER_FILTERS = f"WITH {base.LINES} " + " UNION ALL ".join(
    f"SELECT '{name}' AS filter, doc_id, printed_page, line FROM ({base._matches(f"contains(lower(s), 'th') AND {where}", 's', 2)})" for name, where in (("hint", "printed = 1"), ("all", "true"), ("own", "printed = 2"))
)


def missing_documents(spark, d) -> DataFrame:
    """A run without a document gets an error text, not an exception."""
    c = t(spark, d, "conversations")
    body = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("question"), F.col("role").alias("document_id")))).otherwise(F.col("text"))
    return payloads.run_inputs(c.withColumn("text", body)).select("conv_id", "turn", "document_id", "error")


MISSING_DOCUMENTS = "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN 'user' END AS document_id, CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN NULL ELSE 'error: no document_id' END AS error FROM conversations"


def document_chain(spark, d) -> DataFrame:
    """K1, K2, K3: documents to sections, segments, analyses, section and chapter records."""
    cut = segments.fixed_width(segments.sections(base._docs(spark, d), base._toc(spark, d)), 2000)
    chapters = reduce.reduce_chapters(reduce.reduce_sections(segments.analyzed(cut)))
    return chapters.select("doc_id", "chapter_name", _joined("pages").alias("pages"), _joined("section_names").alias("section_names"))


DOCUMENT_CHAIN = f"""WITH {base.TOC} SELECT doc_id, chapter_name, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages, string_agg(section_name, ',' ORDER BY list_min(pages), section_name) AS section_names
FROM sec WHERE text <> '' GROUP BY doc_id, chapter_name"""


# ---------------------------------------------------------------- texts and settings


def line_counts(spark, d) -> DataFrame:
    """H4: lines of texts with many kinds of line ends, the last one empty."""
    text = F.concat(F.replace(F.replace("text", F.lit("the"), F.lit(" ")), F.lit(" and "), F.lit("\r\n\x0b")), F.lit("\x85"))
    return t(spark, d, "documents").select("doc_id", F.size(X.lines(text)).alias("n_lines")).where("n_lines >= 0")


LINE_COUNTS = r"SELECT doc_id, CAST(len(string_split_regex(replace(replace(text, 'the', chr(8232)), ' and ', chr(13) || chr(10) || chr(11)) || chr(133), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) - 1 AS INTEGER) AS n_lines FROM documents WHERE text IS NOT NULL"


def stripped_texts(spark, d) -> DataFrame:
    """H5: white space of any kind off both ends."""
    text = F.concat(F.lit(" \t\n "), F.col("text"), F.lit("  　\x1f"))
    return t(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.strip(text).cast("binary")).alias("digest"))


STRIPPED_TEXTS = r"SELECT doc_id, md5(regexp_replace(text, '^[\s\x{a0}\x0b\x{2003}\x{3000}\x{85}\x1c-\x1f]+|[\s\x{a0}\x0b\x{2003}\x{3000}\x{85}\x1c-\x1f]+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL"


def token_counts(spark, d) -> DataFrame:
    """Tokens by the fallback ratio, and the same moved into a range."""
    n = X.token_count("text")
    return t(spark, d, "documents").select("doc_id", n.alias("n_tokens"), X.clamp(n, 50, 400).alias("clamped"))


TOKEN_COUNTS = "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS n_tokens, CASE WHEN text IS NULL THEN 400 ELSE CAST(greatest(50, least(400, ceil(length(text) / 4.0))) AS INTEGER) END AS clamped FROM documents"


def file_stems(spark, d) -> DataFrame:
    """H15."""
    return t(spark, d, "customer").select("c_custkey", X.file_stem(F.concat(F.lit("file:/a.b/"), F.col("c_name"), F.lit(".v2.md"))).alias("stem"))


FILE_STEMS = "SELECT c_custkey, c_name || '.v2' AS stem FROM customer"


def message_texts(spark, d) -> DataFrame:
    """Text of message blocks."""
    return t(spark, d, "conversations").select("conv_id", "turn", X.message_text(F.array("role", F.lit(None).cast("string"), F.lit(""), "text")).alias("text"))


MESSAGE_TEXTS = "SELECT conv_id, turn, role || chr(10) || text AS text FROM conversations"


def image_shrink(spark, d) -> DataFrame:
    """By how much cleaning shrank each text."""
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("![alt](a.png)\n\nalt\n"), F.regexp_replace("text", "\n+", "\n"), F.lit("\nend")).alias("text"))
    return clean.clean_images(docs).select("doc_id", "shrink_percent")


IMAGE_SHRINK = r"SELECT doc_id, round(100.0 * 14 / (length(regexp_replace(text, '\n+', chr(10), 'g')) + 23), 1) AS shrink_percent FROM documents WHERE text IS NOT NULL"


def usage_payloads(spark, d) -> DataFrame:
    """Token counts in either shape, with and without a total, and none."""
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": 2, "total_tokens": 9}'))).when(k == 1, F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "completion_tokens": 3}'))).when(k == 2, F.concat(F.lit('{"prompt_tokens": 1, "total_tokens": '), n, F.lit("}"))).otherwise("{}")
    return t(spark, d, "events").select("event_id", X.usage(body).alias("u")).select("event_id", "u.input", "u.output", "u.total")


USAGE_PAYLOADS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 1 ELSE 0 END AS input, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS output,
  CASE event_id % 4 WHEN 0 THEN 9 WHEN 1 THEN event_id + 3 WHEN 2 THEN event_id ELSE 0 END AS total FROM events"""


def json_records(spark, d) -> DataFrame:
    """Rows as JSON, other letters kept, times as text."""
    one = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("é "), F.col("o_orderstatus")).alias("status"), F.array("o_orderpriority").alias("tags"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return t(spark, d, "orders").select("o_orderkey", F.to_json(one).alias("json"))


JSON_RECORDS = """SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"é ' || o_orderstatus || '","tags":["' || o_orderpriority || '"],"at":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS json FROM orders"""


def iso_times(spark, d) -> DataFrame:
    """H19."""
    return t(spark, d, "events").select("event_id", X.iso_utc("ts").alias("at"))


ISO_TIMES = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events"


def backoff_seconds(spark, d) -> DataFrame:
    """Waits before jitter of the first attempts."""
    return t(spark, d, "nation").select("n_nationkey", retry.base_seconds(F.col("n_nationkey") + 1).alias("seconds"))


BACKOFF_SECONDS = "SELECT n_nationkey, least(60.0, pow(2, n_nationkey))::DOUBLE AS seconds FROM nation"

#: defaults as users know them
DEFAULTS = {"grep_limit": 20, "snippet_chars": 200, "page_text_tokens": 8000, "plan_tasks": 10, "chunk_chars": 5000, "chunk_overlap": 500, "toc_pages": 10, "retry_attempts": 5, "run_steps": 100, "reasoning_steps": 25, "worker_steps": 15, "document_steps": 15, "lookup_steps": 20}


def settings(spark, d) -> DataFrame:
    """The settings that hold, as numbers; patterns are left to their tests."""
    rows = [(k, v) for k, v in SETTINGS.described().items() if isinstance(v, int)]
    return spark.createDataFrame(rows, "name string, value long")


SETTINGS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in DEFAULTS.items()) + ") AS z(name, value)"


# ---------------------------------------------------------------- traces


def bad_events(spark, d) -> DataFrame:
    """I5."""
    return traces.bad_events(base.trace_events(spark, d)).select("run_id", "seq")


BAD_EVENTS = f"WITH {base.TRACE} SELECT user_id AS run_id, CAST(seq AS INTEGER) AS seq FROM r WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')"


def call_entries(spark, d) -> DataFrame:
    """I8: every call under its innermost open scope."""
    return traces.call_entries(base.trace_events(spark, d)).select("run_id", "call_id", "name", "scope_id", "entry_no")


CALL_ENTRIES = f"""WITH {base.TRACE},
e AS (SELECT c.run_id, 'c' || c.k AS call_id, c.name, c.seq, CASE WHEN q.scope_id IS NOT NULL AND (q.end_seq IS NULL OR q.end_seq > c.seq) THEN q.scope_id ELSE 'supervisor' END AS scope_id
  FROM call c LEFT JOIN sc q ON q.run_id = c.run_id AND q.k = c.k - 1)
SELECT run_id, call_id, name, scope_id, CAST(row_number() OVER (PARTITION BY run_id, scope_id ORDER BY seq) AS INTEGER) AS entry_no FROM e"""


def token_table(spark, d) -> DataFrame:
    """The lines of the token report."""
    events = base.trace_events(spark, d)
    return traces.token_table(traces.scope_tree(traces.scope_parents(events)), traces.scope_usage(events))


TOKEN_TABLE = base.TREE.rsplit("SELECT run_id, scope_id, kind, depth", 1)[0] + """SELECT t.run_id, CAST(row_number() OVER (PARTITION BY t.run_id ORDER BY path) AS INTEGER) AS place, repeat('  ', depth) || t.scope_id AS label,
  format('{:,}', input_tokens) AS input_tokens, format('{:,}', output_tokens) AS output_tokens, format('{:,}', total_tokens) AS total_tokens, llm_calls FROM t JOIN tot ON tot.run_id = t.run_id AND tot.scope_id = t.scope_id"""


def step_budgets(spark, d) -> DataFrame:
    """K9: scopes over narrow budgets."""
    narrow: Settings = replace(SETTINGS, run_steps=1, lookup_steps=0)
    return traces.over_budget(traces.scope_usage(base.trace_events(spark, d)), narrow)


STEP_BUDGETS = f"""WITH {base.TRACE} SELECT run_id, scope_id, kind, llm_calls, CASE kind WHEN 'supervisor' THEN 1 ELSE 0 END AS budget, llm_calls - CASE kind WHEN 'supervisor' THEN 1 ELSE 0 END AS over
FROM tot WHERE kind IN ('supervisor', 'lookup_agent') AND llm_calls > CASE kind WHEN 'supervisor' THEN 1 ELSE 0 END"""


#: name: (query, SQL)
QUERIES = {
    "chapter_scan": (chapter_scan, CHAPTER_SCAN),
    "chapter_summaries": (chapter_summaries, CHAPTER_SUMMARIES),
    "record_reads": (record_reads, RECORD_READS),
    "segments_meta": (segments_meta, SEGMENTS_META),
    "planner_catalogue": (planner_catalogue, PLANNER_CATALOGUE),
    "work_progress": (work_progress, WORK_PROGRESS),
    "saved_records": (saved_records, SAVED_RECORDS),
    "stored_reads": (stored_reads, STORED_READS),
    "segment_files": (segment_files, SEGMENT_FILES),
    "cached_documents": (cached_documents, CACHED_DOCUMENTS),
    "trace_files": (trace_files, TRACE_FILES),
    "dedup_claims": (dedup_claims, DEDUP_CLAIMS),
    "dedup_decisions": (dedup_decisions, DEDUP_DECISIONS),
    "merge_contradictions": (merge_contradictions, MERGE_CONTRADICTIONS),
    "section_texts": (section_texts, SECTION_TEXTS),
    "chapter_texts": (chapter_texts, CHAPTER_TEXTS),
    "unconfirmed_records": (unconfirmed_records, UNCONFIRMED_RECORDS),
    "error_digests": (error_digests, ERROR_DIGESTS),
    "item_footers": (item_footers, ITEM_FOOTERS),
    "item_pages": (item_pages, ITEM_PAGES),
    "rendered_items": (rendered_items, RENDERED_ITEMS),
    "lookup_answers": (lookup_answers, LOOKUP_ANSWERS),
    "section_answers": (section_answers, SECTION_ANSWERS),
    "document_answers": (document_answers, DOCUMENT_ANSWERS),
    "routed_answers": (routed_answers, ROUTED_ANSWERS),
    "worker_filters": (worker_filters, WORKER_FILTERS),
    "missing_documents": (missing_documents, MISSING_DOCUMENTS),
    "document_chain": (document_chain, DOCUMENT_CHAIN),
    "line_counts": (line_counts, LINE_COUNTS),
    "stripped_texts": (stripped_texts, STRIPPED_TEXTS),
    "token_counts": (token_counts, TOKEN_COUNTS),
    "file_stems": (file_stems, FILE_STEMS),
    "message_texts": (message_texts, MESSAGE_TEXTS),
    "image_shrink": (image_shrink, IMAGE_SHRINK),
    "usage_payloads": (usage_payloads, USAGE_PAYLOADS),
    "json_records": (json_records, JSON_RECORDS),
    "iso_times": (iso_times, ISO_TIMES),
    "backoff_seconds": (backoff_seconds, BACKOFF_SECONDS),
    "settings": (settings, SETTINGS_SQL),
    "bad_events": (bad_events, BAD_EVENTS),
    "call_entries": (call_entries, CALL_ENTRIES),
    "token_table": (token_table, TOKEN_TABLE),
    "step_budgets": (step_budgets, STEP_BUDGETS),
}
