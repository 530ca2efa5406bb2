"""Parts that keep work in bounds: sinks, retries, vocabularies, deep trees, many patterns."""

import base64

import pytest
from pyspark.sql import functions as F

from pagewright.config import SETTINGS
from pagewright.functions import text as X
from pagewright.functions import tokens
from pagewright.operators import grep, pages, segments, store, traces
from pagewright.retry import base_seconds, retried


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_records_are_saved_in_versions(spark, tmp_path):
    path = str(tmp_path / "records")
    assert store.load(spark, path) is None
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, extra string")
    assert store.save(first, path, ["id"]) == 0
    assert store.save(spark.createDataFrame([(2, "B"), (3, "c")], "id int, name string"), path, ["id"]) == 1
    assert got(store.load(spark, path), "id", "name", "extra") == [(1, "a", "x"), (2, "B", "y"), (3, "c", None)]
    with pytest.raises(ValueError):
        store.save(first.union(first.limit(1)), path, ["id"])
    assert store.load(spark, path).count() == 3


def test_older_tables_get_the_columns_they_lack(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS older")
    try:
        spark.sql("CREATE TABLE older.users (id string) USING parquet")
        assert store.create_tables(spark, "older") == list(store.CHAT)
        assert spark.table("older.users").columns == ["id", "identifier", "metadata", "createdAt"]
    finally:
        spark.sql("DROP DATABASE older CASCADE")


def test_retries():
    waits, tries = [], []

    def flaky(x):
        tries.append(x)
        if len(tries) < 4:
            raise TimeoutError
        return x

    assert retried(flaky, wait=waits.append)(7) == 7 and len(waits) == 3
    assert all(b <= w <= 1.2 * b for w, b in zip(waits, (1, 2, 4), strict=True))
    assert [base_seconds(n) for n in (1, 7, 9)] == [1, 60, 60]
    tries.clear()
    with pytest.raises(TimeoutError):
        retried(flaky, attempts=2, wait=waits.append)(1)
    broken = retried(lambda: 1 / 0, wait=waits.append)
    before = len(waits)
    with pytest.raises(ZeroDivisionError):
        broken()
    assert len(waits) == before


def test_tokens_by_a_vocabulary(spark, tmp_path):
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    path = tmp_path / "ranks"
    path.write_text("\n".join(f"{base64.b64encode(r).decode()} {n}" for n, r in enumerate(ranks)))
    pattern = r"\S+|\s+"
    df = spark.createDataFrame([("abc ab",), ("é",), (None,)], "text string")
    count, cut = tokens.counter(str(path), pattern), tokens.truncater(str(path), pattern)
    assert [r[0] for r in df.select(count("text")).collect()] == [3, 2, 0]
    assert [r[0] for r in df.select(cut("text", 1)).collect()] == ["abc" + X.truncated_note(1), X.truncated_note(1), None]
    docs = spark.createDataFrame([(0, "{1}---\nabc ab abc\n1 | T")], "doc_id int, text string")
    toc = spark.createDataFrame([(0, 0, "A", "c", 1)], "doc_id int, pos int, section_name string, chapter_name string, page_number int")
    assert segments.chunked(segments.sections(docs, toc), count=count).first().token_count == 5


def test_deep_and_broken_trees(spark):
    chain = [(1, "s0", "k", None, 0)] + [(1, f"s{n}", "k", f"s{n - 1}", n) for n in range(1, 300)]
    lost = [(2, "supervisor", "k", None, 0), (2, "a", "k", "nowhere", 1), (2, "x", "k", "y", 2), (2, "y", "k", "x", 3)]
    parents = spark.createDataFrame(chain + lost, "run_id int, scope_id string, kind string, parent_scope_id string, order_no int")
    rows = traces.scope_tree(parents).collect()
    assert sorted((r.depth, r.scope_id, r.place) for r in rows if r.run_id == 1) == sorted((n, f"s{n}", n + 1) for n in range(300))
    assert [r.scope_id for r in rows if r.run_id == 2] == ["supervisor"]


def test_step_budgets(spark):
    usage = spark.createDataFrame([(1, "supervisor", "supervisor", SETTINGS.run_steps), (1, "lookup_agent_call_1", "lookup_agent", SETTINGS.lookup_steps + 2), (1, "p", "section_planner", 999)], "run_id int, scope_id string, kind string, llm_calls int")
    assert got(traces.over_budget(usage), "scope_id", "over") == [("lookup_agent_call_1", 2)]


def test_thousands_of_short_patterns(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(12)) for i in range(30)]
    docs = spark.createDataFrame([(i, "{0}-\n" + t + "\n" + "x" * i) for i, t in enumerate(texts)], "doc_id int, text string")
    wanted = [(n, f"w{n % 97} w{n % 89}" if n % 3 else f"W{n % 97}"[: n % 4 + 1]) for n in range(5000)]
    found = grep.grep_many(pages.doc_pages(docs), spark.createDataFrame(wanted, "pattern_id int, pattern string"))
    want = {(n, i) for n, p in wanted for i, t in enumerate(texts) if p.lower() in t or p.lower() in "x" * i}
    assert {(r.pattern_id, r.doc_id) for r in found.select("pattern_id", "doc_id").collect()} == want


def test_sections_in_one_pass_equal_the_joins(spark):
    texts = ["".join(f"{{{n}}}---\n text {i} {n} \n{n % 5 + 1} | T\n" for n in (1, 2, 2, 3, 4, 6)) for i in range(4)] + ["no marker", "{1}---\nno footer", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    toc = spark.createDataFrame([(d, k, f"S{k}", "c", p) for d in range(7) for k, p in enumerate((2, 1, 2, None, 4))], "doc_id int, pos int, section_name string, chapter_name string, page_number int")
    found = pages.ingest_pages(docs)
    columns = ("doc_id", "toc_no", "section_name", "chapter_name", "pages", "text")
    one, many = segments.sections(docs, toc), segments.section_text(segments.toc_ranges(toc, found), found)
    assert got(one, *columns) == got(many, *columns) and one.count() > 8


def test_equal_requests_are_answered_as_often_as_made(spark):
    found = pages.doc_pages(spark.createDataFrame([(0, "{1}-\nbody\n4 | Report")], "doc_id int, text string"))
    asked = spark.createDataFrame([(0, [4]), (0, [4]), (None, [4]), (0, None)], "doc_id int, printed_pages array<int>").repartition(3)
    rows = [(r.doc_id, r.printed_pages, r.found) for r in pages.page_text(found, asked).collect()]
    assert sorted(rows, key=str) == sorted([(0, [4], 1), (0, [4], 1), (None, [4], 0), (0, None, 0)], key=str)


def test_quotes_are_chosen_by_a_parameter(spark):
    from pagewright.operators import reduce

    schema = "doc_id int, seg_no int, seg_id string, section_name string, chapter_name string, pages array<int>, ocr_confidence string, has_table boolean, has_figure boolean, sentiment string, summary string, topics array<string>, salient_quotes array<string>, notable_other array<string>"
    rows = [(1, n, f"s_{n}", "S", "C", [n], "high", False, False, "neutral", "s.", [f"t{n}"], [f"quote {n}", "QUOTE  0"], [f"n{n}", None]) for n in range(20)]
    df = spark.createDataFrame(rows, schema)
    record = reduce.reduce_sections(df).first()
    assert record.salient_quotes == [f"quote {n}" for n in range(10)] and len(record.topics) == len(record.notable_other) == 20
    assert len(reduce.reduce_sections(df, quotes=100).first().salient_quotes) == 20
    empty = reduce.reduce_sections(df.withColumn("topics", F.lit(None).cast("array<string>"))).first()
    assert empty.topics == []


def test_scopes_are_those_of_the_sections_and_no_text_moves(spark):
    texts = ["{1}---\na\n1 | T\n{2}---\n\n2 | T\n{3}---\nc\n3 | T\n{4}---\nd\n3 | T", "{1}---\n\n1 | T", "{7}---\nno footer", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = [(d, n, f"S{n}", "c", p) for d in range(4) for n, p in enumerate((2, 1, 3, None, 3, 99))]
    toc = spark.createDataFrame(rows, "doc_id int, pos int, section_name string, chapter_name string, page_number int")
    columns = ("doc_id", "toc_no", "section_name", "chapter_name", "pages")
    scopes = segments.section_scopes(docs, toc)
    assert got(scopes, *columns) == got(segments.sections(docs, toc), *columns) != []
    node = scopes._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert {node.output().apply(i).name() for i in range(node.output().size())} == {"doc_id", "_held", "_toc"}
