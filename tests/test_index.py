"""The kept index equals a scan, and reads what it has to; needs of patterns."""

import glob
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import grams as G
from pagewright.functions.needs import grams_in, literal_need, regex_need
from pagewright.operators import grep, index, pages

PATTERNS = [
    ("alpha", False), ("ALPHA b", False), ("al", False), ("a.c", False), ("straße", False), ("", False), ("\\E[", False),
    ("alp(ha|ine)s?", True), ("al+pha", True), ("(alpha|beta) gam", True), ("^alpha", True), ("x{3}", True), ("[ab]lpha", True),
    (".*", True), ("a?lp", True), ("(?P<n>ab)c(?P=n)", True), (r"\d+ alpha", True), ("(al)?pine", True), ("(alpha )+beta", True), ("no such thing", False),
    ("k", True), ("ſtop", True), ("[a-c]lp[h-i]a", True), ("(?:al|be)(?:pha|ta)", True), ("alp(?=ha)", True),
]
TEXT = ["{0}-----", "Alpha beta", "ALPINE alphas", "", "nothing", "xxx", "Straße STRASSE", "3 alpha", "alpha alpha beta", "a.c abc", "{1}-----", "abcab beta gamma", "top stop ſtop K", "1 | Report", "\\E[ q", "blpha alpha gam", "𝒳 alpha é", "{2}----", "Report | 2"]


def docs(spark):
    rows = [(i, "\n".join(TEXT[i % 3 :] if i % 3 else TEXT)) for i in range(12)] + [(90, ""), (91, "no page"), (92, "alpha\n" * 50)] + [(None, "{0}---\nalpha"), (5, "{7}---\nalpha\nalpine")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    found, path = pages.doc_pages(docs(spark)), str(tmp_path_factory.mktemp("index"))
    index.add(found, path)
    return found, path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("pattern", "regex"), PATTERNS)
def test_equals_a_scan(spark, kept, pattern, regex):
    found, path = kept
    wanted = grep.X.regex_pattern(pattern) if regex else grep.X.literal_pattern(pattern)
    want = rows(grep.matching(grep.page_lines(found), wanted, None))
    assert rows(index.grep_indexed(spark, path, pattern, regex=regex)) == want
    assert rows(index.grep_indexed(spark, path, pattern, regex=regex, limit=2, pages_filter=[1, 99])) == rows(grep.grep(found, pattern, [1, 99], regex, 2))


def test_kept_pages_are_the_pages(spark, kept):
    found, path = kept
    columns = ["doc_id", "physical_page", "start_line", "end_line", "printed_page", "lines", "page_lines"]
    assert rows(index.pages(spark, path).select(columns)) == rows(found.select(columns))


def test_untouched_documents_are_not_read(spark, tmp_path):
    path, text = str(tmp_path), "{0}---\n%s line"
    for word in ("first", "second", "third"):
        index.add(pages.doc_pages(spark.createDataFrame([(word, text % word)], "doc_id string, text string").coalesce(1)), path)
    files = {f: spark.read.parquet(f).first()["doc_id"] for f in glob.glob(f"{path}/pages/*/*.parquet")}
    assert len(files) == 3
    for file, doc in files.items():
        if doc != "second":
            size = os.path.getsize(file)
            os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
            with open(file, "wb") as out:
                out.write(b"\0" * size)
    assert [r["doc_id"] for r in index.grep_indexed(spark, path, "SECOND").collect()] == ["second"]
    assert [r["doc_id"] for r in index.grep_indexed(spark, path, "sec+ond l", regex=True).collect()] == ["second"]


def test_only_the_lists_of_the_pattern_are_read(spark, kept):
    plan = index.candidates(spark, kept[1], literal_need("alpha"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and re.search(r"PushedFilters: \[.*In\(gram", plan)


def test_empty(spark, tmp_path):
    path = str(tmp_path)
    index.add(pages.doc_pages(spark.createDataFrame([], "doc_id long, text string")), path)
    assert index.grep_indexed(spark, path, "alpha").collect() == []
    assert index.grep_indexed(spark, path, ".", regex=True).collect() == []
    index.add(pages.doc_pages(spark.createDataFrame([(1, "{0}---\nAlpha")], "doc_id long, text string")), path)
    assert [r["line"] for r in index.grep_indexed(spark, path, "alpha").collect()] == [2]


def held(text):
    plain = "".join(chr(c) for c in G.folded(G.np.array([ord(c) for c in text], G.np.uint32)))
    return set(G.of_text(plain))


def meets(need, have):
    if need is None:
        return True
    if need.kind == "gram":
        return need.gram in have
    return (all if need.kind == "all" else any)(meets(p, have) for p in need.parts)


WORD = st.text("abcABC é", min_size=1, max_size=4)
PART = st.recursive(
    st.one_of(WORD.map(re.escape), st.sampled_from([".", "[ab]", "[a-c]", r"\w", "^", "$", "[^a]"])),
    lambda p: st.one_of(st.tuples(p, p).map("".join), st.tuples(p, p).map(lambda x: f"({x[0]}|{x[1]})"), st.tuples(p, st.sampled_from(["?", "*", "+", "{2}", "{0,2}", "+?"])).map(lambda x: f"(?:{x[0]}){x[1]}")),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(PART, st.lists(st.text("abcABC é", max_size=12), max_size=8))
def test_what_matches_meets_the_need(pattern, texts):
    need = regex_need(pattern)
    for text in texts:
        if re.search(pattern, text, re.IGNORECASE):
            assert meets(need, held(text))


def test_needs_of_patterns():
    assert regex_need("ti(?P<x>on|ng)s? the") is not None
    assert grams_in(regex_need("abcd")) == set(G.of_text("abcd")) == grams_in(literal_need("ABCD"))
    for open_one in ("ab", "a.b", "(abc)?", "[a&&b]cde", "[a[b]]cde", "(abc|d)", r"\d\d\d"):
        assert regex_need(open_one) is None
    assert regex_need("(abc|def)").kind == "any" and regex_need("(abc)+").kind == "gram"
