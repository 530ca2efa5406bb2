"""Text functions against Python's own behaviour."""

import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as X

SAMPLES = ["", "a", "a\n", "a\r\nb", "\n\n", "x y\u0085z", "  pad\t", " wide　", "a\x0bb\x0cc", "é🙂 end\n"]


def column(spark, values, made):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", made(F.col("t")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_lines_and_strip(spark):
    assert column(spark, SAMPLES, X.lines) == [s.splitlines() for s in SAMPLES]
    assert column(spark, SAMPLES, X.strip) == [s.strip() for s in SAMPLES]


@pytest.mark.parametrize("pattern", ["abc", "A.C", "\\E+[", "É", "🙂"])
def test_literal_is_case_insensitive_substring(spark, pattern):
    lines = ["xxabcxx", "aBc", "a.c", "x\\e+[y", "cafÉ", "é", "a🙂b", ""]
    want = [pattern.lower() in s.lower() for s in lines]
    assert column(spark, lines, lambda c: c.rlike(X.literal_pattern(pattern))) == want


def snippet(line, m, side):
    a, b = max(0, m.start() - side), min(len(line), m.end() + side)
    return ("…" if a else "") + line[a:b] + ("…" if b < len(line) else "")


def test_snippet(spark):
    lines = ["0123456789target0123456789", "target", "🙂🙂🙂🙂🙂🙂target end", "Target at start of a line", "ends in target", "x target y target z"]
    for side in (3, 200):
        want = [snippet(s, re.search("target", s, re.I), side) for s in lines]
        assert column(spark, lines, lambda c: X.snippet(c, X.literal_pattern("TARGET"), side)) == want


def test_regex_dialect(spark):
    assert column(spark, ["Abc abc", "٣ days"], lambda c: c.rlike(X.regex_pattern(r"(?P<my_w>abc) (?P=my_w)|\d days"))) == [True, True]
    with pytest.raises(ValueError):
        X.regex_pattern("(")


def test_small_functions(spark):
    assert column(spark, ["x" * 12, None, "x" * 5], lambda c: X.preview(c, 10)) == ["x" * 10 + "… (truncated, 2 more chars)", "", "x" * 5]
    assert column(spark, ["x" * 9, "x"], lambda c: X.token_truncate(c, 2)) == ["x" * 8 + "\n\n[truncated at ~2 tokens]", "x"]
    assert column(spark, ["/a/b/Report 1.md", "x.toc.json", ".md"], X.file_stem) == ["Report 1", "x.toc", ".md"]
    assert column(spark, ['["a", "b"]', "no list", "[broken"], X.decoded_list) == [["a", "b"], None, None]
    payloads = ['{"input_tokens": 3, "output_tokens": 2, "total_tokens": 5}', '{"prompt_tokens": 3, "completion_tokens": 4}', '{"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 9}', "{}", "junk", None]
    assert [tuple(u) for u in column(spark, payloads, X.usage)] == [(3, 2, 5), (3, 4, 7), (3, 4, 9), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert spark.range(1000, 1001).select(X.segment_id("id")).first()[0] == "s_1000"
