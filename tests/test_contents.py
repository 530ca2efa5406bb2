"""Contents from documents: chains, mended numbers, noise."""

import itertools
import random

import pytest

from pagewright.operators import contents, pages


def heaviest(items):
    best = 0
    for n in range(len(items) + 1):
        for some in itertools.combinations(sorted(items), n):
            if all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(some)):
                best = max(best, sum(i[2] for i in some))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_chain_is_the_heaviest(seed):
    r = random.Random(seed)
    items = [(r.randint(0, 4), r.randint(0, 6), r.randint(1, 9)) for _ in range(r.randint(0, 9))]
    chosen = [items[k] for k in contents.heaviest_chain(items)]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(chosen))
    assert sum(i[2] for i in chosen) == heaviest(items)


def document(spark, text):
    return pages.doc_pages(spark.createDataFrame([(1, text)], "doc_id int, text string"))


def found(spark, text, **how):
    return [(r["section_name"], r["page_number"], r["found"]) for r in contents.toc_extract(document(spark, text), **how).orderBy("pos").collect()]


def body(*sections):
    """A page for each section: running title, heading, text, footer."""
    return "".join(f"\n{{{n}}}-----\nRunning title\n{s}\nsome text of page {n}\nReport | {n}" for n, s in enumerate(sections, 1))


def test_wrong_numbers_are_mended(spark):
    toc = "{0}-----\nContents\nIntroduction ..... 1\n2. Risk factors .... 9\n| Results | 3 |\nOutlook  4\nNot there …… 7"
    assert found(spark, toc + body("# Introduction", "## 2 RISK FACTORS", "**Results**", "Outlook")) == [("Introduction", 1, True), ("2. Risk factors", 2, True), ("Results", 3, True), ("Outlook", 4, True), ("Not there", 7, False)]


def test_numbers_from_elsewhere_and_repeats_in_the_text(spark):
    toc = "{0}-----\nAlpha .... 11\nBeta .... 12\nGamma .... 13\nLost .... 14"
    text = toc + body("# Alpha", "Gamma\n# Beta\nalpha", "# Gamma\nBeta", "nothing")
    assert found(spark, text) == [("Alpha", 1, True), ("Beta", 2, True), ("Gamma", 3, True), ("Lost", 4, False)]


def test_no_contents_and_empty(spark):
    assert found(spark, "{0}-----\nplain text\nin 1999" + body("# Alpha")) == []
    assert found(spark, "") == []
    assert found(spark, "{0}-----\nAlpha .... 1" + body("# Alpha"), first=0) == []
    none = spark.createDataFrame([], "doc_id int, text string")
    assert contents.toc_extract(pages.doc_pages(none)).collect() == []
