"""SQL access: views of a corpus and table functions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import grep, pages


def register(docs: DataFrame, prefix: str = "corpus") -> list[str]:
    """Temporary views ``<prefix>_pages``, ``_lines``, ``_page_map`` and
    ``_page_list``, and the table functions ``<prefix>_grep(pattern)`` and
    ``<prefix>_page_text(doc, printed)``."""
    spark = docs.sparkSession
    found = pages.doc_pages(docs)
    views = {"pages": found, "lines": grep.page_lines(found), "page_map": pages.page_map(found), "page_list": pages.list_pages(found)}
    for name, view in views.items():
        view.createOrReplaceTempView(f"{prefix}_{name}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_grep(wanted STRING)
        RETURNS TABLE (doc_id {kind}, printed_page INT, physical_page INT, line INT, text STRING)
        RETURN SELECT doc_id, printed_page, physical_page, line, text FROM {prefix}_lines WHERE contains(lower(text), lower(wanted))""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_page_text(doc {kind}, printed INT)
        RETURNS TABLE (text STRING)
        RETURN SELECT array_join(transform(p.page_lines, x -> x.text), '\\n') FROM {prefix}_pages p
               JOIN {prefix}_page_map m ON p.doc_id = m.doc_id AND p.physical_page = m.physical_page WHERE m.doc_id = doc AND m.printed_page = printed""")
    return [f"{prefix}_{name}" for name in (*views, "grep", "page_text")]
