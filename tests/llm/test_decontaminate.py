import random
import tracemalloc

import numpy as np

from pagewright.llm import decontaminate


def distance(item, text):
    """Fewest edits between item and any part of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_align_is_the_plain_recurrence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 12), rng.randint(0, 20)))
        assert decontaminate.align(decontaminate.codes(a), decontaminate.codes(b))[0] == distance(a, b)


def test_finds_just_what_brute_force_finds():
    rng = random.Random(9)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([30, 60, 90])))) for i in range(8)]
    ready = decontaminate.Items(items)
    for _ in range(60):
        parts = []
        for _ in range(4):
            parts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))))
            chars = list(rng.choice(items)[1].upper())
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice([[], ["z"], [chars[at], "z"]])
            parts.append("".join(chars))
        text = "".join(parts)
        found = {f[0] for f in ready.search(text)}
        want = {ready.ids[n] for n, c in enumerate(ready.codes) if distance(c.tolist(), decontaminate.codes(text).tolist()) <= ready.edits[n]}
        assert found == want


def test_rows(spark):
    passage = "the committee met on the third of may to decide upon the matter of the northern bridge"
    docs = [(1, f"x {passage} y", "a"), (2, passage.upper(), "b"), (3, "clean words only", None), (4, None, "d"), (5, "", "e"), (None, passage, "f"), (1, f"x {passage} y", "a"), (6, "w " * 40_000 + passage, "g")]
    items = [(10, passage, 0), (11, None, 1), (12, "", 1), (13, "tiny", 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(2)
    i = spark.createDataFrame(items, "item_id int, text string, doc_id int")
    for chunk in (4_000_000, 50):
        got = sorted(((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.leaks(d, i, chunk=chunk).collect()), key=str)
        n = len(passage)
        assert got == sorted([(1, 10, 2, 2 + n, 0), (1, 10, 2, 2 + n, 0), (2, 10, 0, n, 0), (None, 10, 0, n, 0), (6, 10, 80_000, 80_000 + n, 0)], key=str)
        assert sorted(r.doc_id for r in decontaminate.without_leaks(d, i, chunk=chunk).collect()) == [3, 4, 5]
    assert decontaminate.leaks(d, i.where("false")).count() == 0
    assert decontaminate.leaks(d.where("false"), i).count() == 0


def test_grams_depend_on_their_characters_alone():
    a, b = decontaminate.codes("xxabcdefghij"), decontaminate.codes("abcdefghijyy")
    for q in (3, 8, 11):
        assert np.intersect1d(decontaminate.grams(a, q), decontaminate.grams(b, q)).size >= max(0, 10 - q + 1)


def test_places_of_short_items_are_places_in_the_text():
    ready = decontaminate.Items([(1, "tiny"), (2, "İx")])
    assert ready.search("İİİ tiny İX") == [(1, 4, 8, 0), (2, 9, 11, 0)]


def test_runs_of_one_letter_take_bounded_memory(monkeypatch):
    item = "a" * 400
    whole = decontaminate.Items([(1, item)]).search("b" * 50 + "a" * 3000 + "b")
    assert [w[1:] for w in whole][:2] == [(50, 450, 0), (450, 850, 0)] or len(whole) >= 6
    monkeypatch.setattr(decontaminate, "SLICE", 1000)
    assert decontaminate.Items([(1, item)]).search("b" * 50 + "a" * 3000 + "b") == whole
    tracemalloc.start()
    assert decontaminate.Items([(1, item)]).search("a" * 60_000)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_equal_and_long_items_are_dealt_in_measured_parts(spark):
    rows = [(1, "same words of an item")] * 5 + [(2, "x" * 300)] + [(n, f"item number {n}") for n in range(3, 60)]
    items = spark.createDataFrame(rows, "item_id int, text string")
    parts = [p.collect() for p in decontaminate._chunks(items, "item_id", "text", 100)]
    assert sorted((r.i, r.n) for p in parts for r in p) == [(1, 5), (2, 1), *((n, 1) for n in range(3, 60))]
    assert all(len(p) <= 1 or sum(len(r.t) for r in p) <= 100 for p in parts)


def test_items_on_many_rows_are_found_as_often(spark):
    item = "a passage of some words that no other text would hold"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)] * 3000 + [(8, item), (None, item)], "item_id long, text string")
    got = decontaminate.leaks(docs, items).groupBy("doc_id", "item_id").count().collect()
    assert sorted(map(tuple, got), key=str) == [(1, 7, 3000), (1, 8, 1), (1, None, 1)]
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()] == [2]
