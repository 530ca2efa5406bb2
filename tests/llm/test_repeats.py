"""Prefix-free-parsing removal against a plain definition."""

import hashlib
import random

import numpy as np
import pytest

from pagewright.llm import repeats


def plain(rows, window=50):
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - window + 1):
            w = data[s : s + window]
            k = repeats.NO_ID if i is None else i
            first[w] = min(first.get(w, k), k)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - window + 1):
            if first[data[s : s + window]] < (repeats.NO_ID if i is None else i):
                gone[s : s + window] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    return sorted(((r[0], r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def test_equals_plain_definition(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(n) for n in (8, 15, 30, 60)]
    rows = []
    for i in range(120):
        text = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(shared) + text[at:]
        rows.append((rng.randint(0, 100), text))
    rows += [(500, rows[3][1]), (501, rows[3][1][:-4]), (502, None), (None, rows[5][1]), (503, ""), (504, "a" * 300), (505, "a" * 200), (506, "ab" * 90), (507, prose(12000)), (7, rows[3][1])]
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, block int").repartition(3)
    assert found(repeats.remove_repeats(df, block_bytes=3000)) == plain(rows)
    # hot triggers: all that more than one block has, then those of more than four, folded two blocks at a time
    for most, fan in ((1, 2), (4, 2), (1, 1000)):
        assert found(repeats.remove_repeats(df, block_bytes=700, most=most, fan=fan)) == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0


def test_window_bounds(spark):
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=100)
