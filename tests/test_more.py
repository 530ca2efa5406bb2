"""Rule-based analysis, item rendering, catalogue and table creation."""

import json

from pyspark.sql import functions as F

from pagewright.operators import pages, reduce, segments, store


def test_analysis_feeds_the_reduction(spark):
    text = "Strong growth of 4.5 million at Acme Holdings Limited. There is a risk of loss.\nFigure: a chart\n| a | b |"
    rows = spark.createDataFrame([(1, 0, "s_000", "S", "C", [1], 10, text), (1, 1, "s_001", "S", "C", [2], 10, "Plain words.")], "doc_id int, seg_no int, seg_id string, section_name string, chapter_name string, pages array<int>, token_count int, text string")
    found = segments.analyzed(rows).orderBy("seg_no").collect()
    a, b = found
    assert (a.has_table, a.has_figure, a.sentiment, a.ocr_confidence) == (True, True, "mixed", "high")
    assert [(m.name, m.value_text, m.numeric_value) for m in a.metrics] == [("million", "4.5 million", 4.5e6)]
    assert [e.name for e in a.key_entities] == ["Acme Holdings Limited"] and [r.text for r in a.risks] == ["There is a risk of loss."]
    assert (b.has_table, b.has_figure, b.sentiment) == (False, False, "neutral")
    record = reduce.reduce_sections(segments.analyzed(rows)).first()
    assert record.pages == [1, 2] and record.sentiment == "neutral" and record.has_table
    assert reduce.unconfirmed(segments.analyzed(rows)).where(F.size("errors") > 0).count() == 0


def test_items(spark):
    items = spark.createDataFrame(
        [(1, 0, 1, "header", None, "Head"), (1, 1, 1, "heading", 2, "Title"), (1, 2, 1, "text", None, "Body"), (1, 3, 1, "list", None, "point"), (1, 4, 1, "code", None, "x = 1"), (1, 5, 1, "footer", None, "Page 7"), (1, 6, 2, "footer", None, "none"), (1, 7, 2, "footer", None, "9")],
        "doc_id int, seq int, page_no int, kind string, level int, text string",
    )
    assert [r.text for r in pages.rendered_items(items).collect()] == ["## Title\n\nBody\n\n- point\n\n```\nx = 1\n```"]
    labels = spark.createDataFrame([(1, 1, "i"), (1, 3, "iii")], "doc_id int, page_no int, label string")
    assert sorted(tuple(r) for r in pages.item_pages(items, labels).collect()) == [(1, 1, "7"), (1, 2, "9"), (1, 3, "iii")]


def test_catalogue_scans_and_tables(spark):
    rows = spark.createDataFrame([(1, "B", "c", [5], "sb"), (1, "A", "c", [2], "sa"), (1, "N", "c", None, "sn"), (2, "A", "c", [1], "x")], "doc_id int, section_name string, chapter_name string, pages array<int>, summary string")
    listed = {r.doc_id: json.loads(r.catalogue) for r in store.catalogue_json(rows).collect()}
    assert [s["section_name"] for s in listed[1]] == ["A", "B", "N"]
    assert store.list_sections(rows, 1).count() == 3 and store.list_chapters(rows, 2).count() == 1
    chapters = rows.withColumn("section_names", F.array("section_name"))
    assert store.list_chapter_summaries(chapters, 2).first().summary == "x"
    meta = rows.withColumn("seg_no", F.lit(1)).withColumn("seg_id", F.lit("s")).withColumn("token_count", F.lit(1))
    assert store.segments_meta(meta, 1, "A").count() == 1
    spark.sql("CREATE DATABASE IF NOT EXISTS chat")
    try:
        assert store.create_tables(spark, "chat") == store.create_tables(spark, "chat") == ["users", "threads", "steps", "feedbacks", "elements"]
    finally:
        spark.sql("DROP DATABASE chat CASCADE")
