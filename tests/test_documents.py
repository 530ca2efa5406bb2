"""Page grammars, search, cleaning, sections and segments on hand-made text."""

import pytest

from pagewright.operators import clean, grep, pages, segments


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


DOC = "front\n{0}---\nno footer\n{1}---\nalpha beta\n02 | Report\nmore\n{2}-\nalpha\n**Report | 3**\n{3}---\nsame number\n3 | Report"


def test_query_pages(spark):
    found = pages.doc_pages(frame(spark, DOC, "no markers at all", None))
    assert got(found, "doc_id", "physical_page", "start_line", "end_line", "printed_page") == [(0, 0, 3, 3, None), (0, 1, 5, 7, 2), (0, 2, 9, 10, 3), (0, 3, 12, 13, 3)]
    assert got(pages.page_map(found), "printed_page", "physical_page") == [(2, 1), (3, 2)]
    assert got(pages.list_pages(found), "printed_page_min", "printed_page_max", "printed_page_count", "physical_page_count", "has_unmapped_pages") == [(2, 3, 2, 4, True)]


def test_markers_out_of_order_and_repeated(spark):
    found = pages.doc_pages(frame(spark, "{1}-\nold\n{0}-\nzero\n{2}-\ntwo\n{1}-\nnew"))
    # page 0 begins at line 4 and runs up to the last marker of page 1; page 2 owns its line; page 1 would end before it starts
    spans = {r.physical_page: (r.start_line, r.end_line, [x.line for x in r.lines]) for r in found.collect()}
    assert spans == {0: (4, 6, [4, 5]), 2: (6, 8, [6, 7, 8])} or spans[2][2] == [6, 7, 8]
    lines = [x.line for r in found.collect() for x in r.lines]
    assert len(lines) == len(set(lines))


def test_ingest_pages(spark):
    text = "skip {0}---front{1}-- not a marker\n7 | Some Title\n\n{2}---\nbody\nTitle | **12**\n"
    rows = got(pages.ingest_pages(frame(spark, text, "whole text")), "doc_id", "pos", "page_number", "printed_page")
    assert rows == [(0, 0, 0, 7), (0, 1, 2, 12), (1, 0, 0, None)]
    strip = pages.ingest_pages(frame(spark, "{1}---a\n12 | T\n")).select(pages.strip_footer("text", "printed_page"), pages.strip_footer("text", pages.F.lit(2)), pages.strip_footer("text", pages.F.lit(5))).first()
    assert tuple(strip) == ("a", "a", "a\n12 | T")


def test_first_n_pages(spark):
    text = "x{0}---\n a \n{1}---b{12}---c{2}---d"
    assert [r.text for r in pages.first_n_pages(frame(spark, text, "plain")).orderBy("doc_id").collect()] == ["--- Page 1 ---\na\n\n--- Page 2 ---\nb", "plain"]


def test_grep(spark):
    found = pages.doc_pages(frame(spark, DOC))
    assert got(grep.grep(found, "ALPHA"), "printed_page", "physical_page", "line", "snippet") == [(2, 1, 5, "alpha beta"), (3, 2, 9, "alpha")]
    assert got(grep.grep(found, "alpha", pages_filter=[3, 99]), "line") == [(9,)]
    assert got(grep.grep(found, "alpha", pages_filter=[99]), "line") == []
    assert got(grep.grep(found, "alpha", pages_filter=[]), "line") == [(5,), (9,)]
    assert len(grep.grep(found, "alpha", limit=0).collect()) == 1
    assert got(grep.grep(found, "^no", regex=True), "printed_page", "line") == [(None, 3)]
    assert got(grep.grep(found, "front"), "line") == [] and got(grep.grep(found, "{1}"), "line") == []
    many = pages.doc_pages(frame(spark, "{0}-\n" + "hit\n" * 50))
    assert grep.grep(many, "hit", limit=1000).count() == 20
    assert grep.worker_filter(None, [1]) == [1] and grep.worker_filter([], [1]) is None and grep.worker_filter([2], [1]) == [2]


def test_grep_many_and_quotes(spark):
    found = pages.doc_pages(frame(spark, DOC))
    patterns = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "same number"), (4, ""), (5, None), (6, "no Footer x")], "pattern_id int, pattern string")
    assert got(grep.grep_many(found, patterns), "pattern_id", "line") == [(1, 5), (2, 5), (3, 12)]
    quotes = spark.createDataFrame([(1, 0, 2, "Alpha BETA"), (2, 0, 3, "alpha beta"), (3, 0, 2, "nowhere"), (4, 5, 1, "x"), (5, 0, 3, "same number")], "quote_id int, doc_id int, printed_page int, quote string")
    assert got(grep.verify_quotes(found, quotes), "quote_id", "status", "pages") == [(1, "found", [2]), (2, "other page", [2]), (3, "absent", []), (4, "absent", []), (5, "other page", [3])]


def test_page_text(spark):
    found = pages.doc_pages(frame(spark, DOC))
    asked = spark.createDataFrame([(0, [3, 2, 3, 9]), (0, [9]), (0, [])], "doc_id int, printed_pages array<int>")
    rows = {tuple(r.printed_pages): r for r in pages.page_text(found, asked).collect()}
    assert rows[(3, 2, 3, 9)].text == "--- Printed page 3 ---\nalpha\n**Report | 3**\n\n--- Printed page 2 ---\nalpha beta\n02 | Report\nmore\n\n--- Printed page 3 ---\nalpha\n**Report | 3**\n\n[note: printed pages with no footer mapping skipped: [9]]"
    assert rows[(9,)].text is None and "9" in rows[(9,)].error
    assert rows[()].text == "" and rows[()].error is None
    assert pages.page_text(found, asked.limit(1), 5).first().text.startswith("--- Printed page 3 -\n\n[truncated at ~5 tokens]")


def test_clean_images(spark):
    image = "![a chart](h.PNG)"
    texts = [f"{image}\n\na chart\nrest", f"{image}\nrich\n\n\n\na chart\nrest", f"{image}\n# Head\na chart", f"{image}\n![b](x.jpg)\na chart", image + "\n" + "x\n" * 199 + "a chart", image + "\n" + "x\n" * 200 + "a chart", "![no](x.pdf)\nno"]
    rows = clean.clean_images(frame(spark, *texts)).orderBy("doc_id").collect()
    assert [(r.n_next, r.n_later, r.n_figure) for r in rows] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 0, 1), (0, 0, 0)]
    assert [r.text for r in rows[:4]] == ["\na chart\nrest", "rich\n\nrest", "Figure: a chart\n# Head\na chart", "Figure: a chart\nFigure: b\na chart"]


def test_sections(spark):
    text = "".join(f"{{{i}}}---\ntext {i}\n{i} | T\n" for i in range(1, 7))
    toc = spark.createDataFrame([(0, 0, "A", "c", 1), (0, 1, "B", "c", 3), (0, 2, "B2", "c", 3), (0, 3, "N", "c", None), (0, 4, "Z", "d", 5)], "doc_id int, pos int, section_name string, chapter_name string, page_number int")
    found = pages.ingest_pages(frame(spark, text))
    ranges = segments.toc_ranges(toc, found)
    assert got(ranges, "toc_no", "section_name", "start_page", "end_page") == [(0, "A", 1, 2), (1, "B", 3, 3), (2, "B2", 3, 4), (3, "Z", 5, 6)]
    assert got(segments.section_text(ranges, found), "section_name", "pages", "text")[0] == ("A", [1, 2], "text 1\n\ntext 2")
    made = segments.segments(frame(spark, text), toc, 10, 0).orderBy("seg_no").collect()
    assert [m.seg_id for m in made][:2] == ["s_000", "s_001"] and made[0].token_count == 2


@pytest.mark.parametrize("size,overlap", [(20, 5), (50, 0), (7, 3)])
def test_chunks(size, overlap):
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(i % 9)) for i in range(30)) + "x" * 60
    out = segments.chunks(text, size, overlap)
    assert all(len(c) <= size for c in out)
    if not overlap:
        assert "".join("".join(out).split()) == "".join(text.split())
    assert segments.chunks("", size, overlap) == [] and segments.chunks("a b", size, overlap) == ["a b"]


def test_item_footers(spark):
    texts = ["12", "Page 7 of 9", "Report | 5 |", "sum 2024 99", "31 March", "99999", "none", "  8  "]
    rows = frame(spark, *texts).select("doc_id", pages.item_footer("text").alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in rows] == [12, 7, 5, 99, 31, None, None, 8]


def test_line_texts_meet_candidates_once(spark):
    docs = spark.createDataFrame([(1, "{0}---\nsome inner words\nno such line")], "doc_id int, text string")
    patterns = spark.createDataFrame([(1, "inner"), (2, "INNER w"), (3, "absent")], "pattern_id int, pattern string")
    found = grep.grep_many(pages.doc_pages(docs), patterns)
    assert got(found, "pattern_id", "line") == [(1, 2), (2, 2)]
    # one join by gram and one by line; a third would carry the line's text once for each candidate
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
