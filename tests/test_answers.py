"""Composite queries, SQL access and file sources."""

import json

from pagewright.operators import pages
from pagewright.plans import answers
from pagewright.sources import corpus, sql

DOC = "{0}---\nfront matter\n{1}---\ncapital growth rose\n1 | Report\n{2}---\nstaff numbers fell\ncapital plans\n2 | Report"


def parts(spark):
    docs = spark.createDataFrame([(1, DOC), (2, "{0}---\ncapital elsewhere")], "doc_id int, text string")
    sections = spark.createDataFrame([(1, "Capital", "growth of capital", [1]), (1, "People", "staff", [2])], "doc_id int, section_name string, summary string, pages array<int>")
    return docs, pages.doc_pages(docs), sections


def test_answers_by_route_and_failover(spark):
    docs, found, sections = parts(spark)
    asked = spark.createDataFrame([(1, 1, "where is capital"), (2, 1, "why did capital growth change"), (3, 1, "why fell numbers"), (4, 2, "where is nothing")], "question_id int, doc_id int, question string")
    got = sorted((r.question_id, r.route, r.printed_page, r.line) for r in answers.answers(asked, found, sections).collect())
    assert got == [(1, "lookup", 1, 4), (1, "lookup", 2, 8), (2, "reason", 1, 4), (3, "lookup", 2, 7)]
    scoped = spark.createDataFrame([(1, 1, "capital", [2]), (2, 1, "capital", []), (3, 1, "capital", [99])], "question_id int, doc_id int, question string, pages_filter array<int>")
    assert sorted((r.question_id, r.line) for r in answers.lookup(scoped, found).collect()) == [(1, 8), (2, 4), (2, 8)]
    chapters = spark.createDataFrame([(1, "One", "capital growth"), (1, "Two", "staff")], "doc_id int, chapter_name string, summary string")
    asked = spark.createDataFrame([(1, 1, "capital?"), (2, 1, "list all risks")], "question_id int, doc_id int, question string")
    assert sorted((r.question_id, r.chapter_name) for r in answers.document_agent(asked, chapters).collect()) == [(1, "One"), (2, "One"), (2, "Two")]


def test_sql_access(spark):
    docs, _, _ = parts(spark)
    sql.register(docs)
    assert [tuple(r) for r in spark.sql("SELECT doc_id, printed_page, line FROM corpus_grep('CAPITAL') ORDER BY 1, 3").collect()] == [(1, 1, 4), (1, 2, 8), (2, None, 2)]
    assert spark.sql("SELECT * FROM corpus_page_text(1, 2)").first().text == "staff numbers fell\ncapital plans\n2 | Report"


def test_files(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "My Report.md").write_text(DOC)
    docs = corpus.read_markdown(spark, str(tmp_path / "md"))
    assert tuple(docs.select("doc_id", "page_count").first()) == ("My Report", 3)
    toc = [{"section_name": "A", "chapter_name": "c", "page_number": 1}, {"section_name": "B", "chapter_name": "c", "page_number": "x"}]
    (tmp_path / "My Report.toc.json").write_text(json.dumps(toc))
    assert [tuple(r) for r in corpus.read_toc(spark, str(tmp_path / "My Report.toc.json")).orderBy("section_name").collect()] == [("My Report", "A", "c", 1), ("My Report", "B", "c", None)]
    columns = "doc_id string, seg_no int, seg_id string, section_name string, chapter_name string, pages array<int>, token_count int, text string"
    rows = spark.createDataFrame([("d", 1, "s_001", "S", "C", [1], 2, "t1"), ("d", 0, "s_000", "S", "C", [1], 2, "t0")], columns)
    corpus.write_segments(rows, str(tmp_path / "seg"))
    assert [r.seg_id for r in corpus.read_segments(spark, str(tmp_path / "seg"), one_a_line=True).collect()] == ["s_000", "s_001"]
    assert corpus.write_traces(rows, str(tmp_path / "t")) and not corpus.write_traces(rows, "nowhere://x")
    upper = corpus.converted(spark, str(tmp_path / "md"), lambda data: data.decode().upper())
    assert upper.first().text == DOC.upper()


def test_lines_stay_in_their_page_till_they_are_evidence(spark):
    docs, found, sections = parts(spark)
    asked = spark.createDataFrame([(1, 1, "where is capital"), (1, 1, "staff fell"), (2, 1, None), (3, None, "capital")], "question_id int, doc_id int, question string")
    best = answers.lookup(asked, found.unionByName(found), 2)
    # repeats of a question's id are one question, repeats of a page one page
    assert sorted((r.question_id, r.line, r.score) for r in best.collect()) == [(1, 4, 1), (1, 7, 2)]
    plan = answers.lookup(asked, found, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join", 1)[1].count("Generate explode") == 1
    tasks = asked.select("question_id", "doc_id", "question").toDF("question_id", "doc_id", "sub_query").join(sections.select("doc_id", "section_name"), "doc_id")
    plan = answers.section_workers(tasks, found, sections)._jdf.queryExecution().optimizedPlan().toString()
    assert "(term#" not in plan.split("Join", 1)[1] and "Generate explode(_terms" not in plan


def test_sections_are_worked_out_once_and_only_lines_asked_for_move(spark):
    docs, found, sections = parts(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    asked = spark.createDataFrame([(1, 1, "where is capital"), (2, 1, "why did capital growth change"), (3, 1, "why fell numbers"), (4, 2, "where is nothing")], "question_id int, doc_id int, question string")
    got = sorted((r.question_id, r.route, r.line) for r in answers.answers(asked, found, sections.mapInPandas(counted, sections.schema)).collect())
    assert got == [(1, "lookup", 4), (1, "lookup", 8), (2, "reason", 4), (3, "lookup", 7)]
    assert seen.value == 2
    moved = answers._lines_with(found, ["capital", "fell"]).collect()
    assert sorted((r.doc_id, r.physical_page, [(x.line, list(x.terms)) for x in r._lines]) for r in moved) == [(1, 0, []), (1, 1, [(4, ["capital"])]), (1, 2, [(7, ["fell"]), (8, ["capital"])]), (2, 0, [(2, ["capital"])])]


def test_many_terms_give_the_same_evidence(spark, monkeypatch):
    _, found, sections = parts(spark)
    asked = spark.createDataFrame([(1, 1, "capital numbers staff", [2]), (2, 1, "growth fell", None)], "question_id int, doc_id int, question string, pages_filter array<int>")
    tasks = sections.selectExpr("1 as question_id", "doc_id", "section_name", "summary as sub_query")
    evidence = lambda: [sorted(map(tuple, df.collect())) for df in (answers.lookup(asked, found, 2), answers.section_workers(tasks, found, sections, 1))]
    few = evidence()
    assert all(few)
    monkeypatch.setattr(answers, "VOCABULARY", 1)
    monkeypatch.setattr(answers, "BROADCAST", 0)
    assert evidence() == few
