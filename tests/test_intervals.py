"""Interval joins against plain comparison."""

import random

from pagewright.operators.intervals import in_ranges
from pagewright.operators.segments import section_pages

POINTS, RANGES = "doc_id int, at int, p int", "doc_id int, low int, high int, r int"


def test_equals_plain_comparison(spark):
    r = random.Random(1)
    points = [(r.choice([1, 1, 1, 2, None]), r.choice([None, r.randint(-50, 300), 2**31 - 1, -(2**31)]), n) for n in range(150)]
    ends = lambda: r.choice([None, r.randint(-60, 310), 2**31 - 1])
    ranges = [(r.choice([1, 1, 2, 3, None]), ends(), ends(), n) for n in range(80)] + [(1, 5, 4, 900), (1, 0, 2_000_000_000, 901), (1, 7, 7, 902), (1, 7, 7, 903)]
    got = in_ranges(spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), ["doc_id"], "at", "low", "high")
    want = [(p, q) for d, at, p in points for e, low, high, q in ranges if d is not None and d == e and at is not None and (low is None or at >= low) and (high is None or at <= high)]
    assert sorted((x["p"], x["r"]) for x in got.collect()) == sorted(want) and want


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], POINTS), spark.createDataFrame([(1, 2, 3)], POINTS)
    assert in_ranges(one, spark.createDataFrame([], RANGES), ["doc_id"], "at", "low", "high").collect() == []
    assert in_ranges(none, spark.createDataFrame([(1, 0, 9, 1)], RANGES), ["doc_id"], "at", "low", "high").collect() == []


def test_contents_with_an_absurd_number(spark):
    ranges = spark.createDataFrame([(1, 0, "A", "C", 1, 1_999_999_999), (1, 1, "B", "C", 2_000_000_000, 2_000_000_000)], "doc_id int, toc_no int, section_name string, chapter_name string, start_page int, end_page int")
    pages = spark.createDataFrame([(1, n, n, f"t{n}", n) for n in range(5)], "doc_id int, pos int, page_number int, text string, printed_page int")
    assert sorted((r["section_name"], r["printed_page"]) for r in section_pages(ranges, pages).collect()) == [("A", n) for n in range(1, 5)]
