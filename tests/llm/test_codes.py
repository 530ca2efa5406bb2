"""Vector codes against a plain definition on Python integers."""

import hashlib
import math

import numpy as np
import pytest

from pagewright.llm.codes import Tree, compressed

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, parts=4, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1]))
    ints = [(r[0], r[2], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in kept]
    w = len(ints[0][2]) // parts
    cuts = [[x[p * w : p * w + w] for p in range(parts)] for _, _, x in ints]
    seeds = {}
    for (i, _, _), c in zip(ints, cuts, strict=True):
        seeds.setdefault(i, c)
    books = [[c[p] for c in list(seeds.values())[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cuts:
                own[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(v) // len(o) for v in zip(*o, strict=True)] if o else e for e, o in zip(books[p], own, strict=True)]
    out = [(i, label, [nearest(c[p], books[p]) for p in range(parts)]) for (i, label, _), c in zip(ints, cuts, strict=True)]
    sums = {}
    for _, label, f in out:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), sums[label], digest) for i, label, f in out)


def found(df, **how):
    return sorted(tuple(r) for r in compressed(df, **how).select("id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("entries", [5, 256])
def test_equals_plain_definition(spark, entries):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8).round(1)], None if i % 5 == 0 else i % 3, "x") for i in range(120)]
    rows += [(200 + i, rows[7][1], 1, None) for i in range(60)]  # one vector a third of the rows
    rows += [(300, None, 1, ""), (301, [1.0, None] * 4, 1, ""), (302, [float("nan")] * 8, 1, ""), (303, [float("inf")] * 8, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, entries=entries) == plain(rows, entries=entries)


def test_repeated_rows_ties_and_odd_lengths(spark):
    rows = [(1, [0.0] * 4, 1, ""), (1, [0.0] * 4, 1, ""), (2, [0.0] * 4, None, ""), (3, [1.0] * 4, None, "")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    odd = [*rows, (0, [1.0] * 3, 1, ""), (9, [1.0] * 8, 1, ""), (10, [], 1, "")]
    assert found(spark.createDataFrame(odd, SCHEMA)) == plain(rows)
    # null ids are coded and seed nothing
    with_null = compressed(spark.createDataFrame([*rows, (None, [1.0] * 4, 5, "")], SCHEMA)).where("id is null").first()
    assert with_null["code"] == "02020202" and with_null["error"] == 0


def test_empty_and_huge(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, [1.0] * 4, 1, "")], SCHEMA)) == [(None, None, None, None, None)]
    huge = [(1, [3e38] * 4, 1, ""), (2, [-3e38] * 4, 1, ""), (3, [2.0**52] * 4, 1, "")]
    got = found(spark.createDataFrame(huge, SCHEMA), entries=2)
    assert [r[0] for r in got] == [1, 2, 3] and all(r[2] is None or r[2] >= 0 for r in got)


def test_tree_breaks_ties_by_index():
    r = np.random.default_rng(1)
    entries = r.integers(-3, 4, (256, 4))
    points = r.integers(-4, 5, (500, 4))
    index, least = Tree(entries).nearest(points)
    squares = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (least == squares.min(1)).all() and (index == squares.argmin(1)).all()
