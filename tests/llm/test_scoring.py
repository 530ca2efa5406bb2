"""Language-model scores against a plain model on dictionaries."""

import math
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import scoring as S
from pagewright.llm.registry import queries

SCHEMA = "doc_id long, text string, name string, size long"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def named(word):
    if word is None:
        return S.END
    if word == "":
        return S.BEGIN
    data = np.frombuffer(word.encode(), np.uint8)
    return S.word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def plain(rows, chains=S.CHAINS, rounds=S.ROUNDS):
    """As the module's first paragraphs say, one dish after the other; '' is the
    begin of a text and None its end."""
    pairs, seen = Counter(), Counter()
    for i, text in rows:
        if i is not None and i % 7 != 2:
            words = tokens(text)
            seen.update(words)
            pairs.update(pairwise(["", *words]))
    n, v = seen.total(), len(seen)
    context = Counter()
    for (u, _), c in pairs.items():
        context[u] += c
    kinds = lambda counter: S.discount_of(*(sum(c == k for c in counter.values()) for k in (1, 2)))
    k0, t0 = Counter(w for _, w in pairs), Counter(u for u, _ in pairs)
    d0, d1 = kinds(k0), kinds(pairs)
    strong, weak = S.STRENGTHS
    seeds = {p: S.mixed(named(p[0]).reshape(1) * np.uint64(S.FACTOR) + named(p[1])) for p in pairs}
    one = lambda x, kind=float: np.array([x], kind)
    chances = []
    for chain in range(chains):
        k, t, r, seat = k0, t0, Counter(dict.fromkeys(k0, 1)), dict.fromkeys(pairs, 1)
        for turn in range(rounds + 1):
            parent = lambda w, k=k, r=r: (k[w] - d0 * r[w] + (strong + d0 * r.total()) / (v + 1)) / (strong + k.total())
            if turn == rounds:
                break
            place = (turn + 1) * chains + chain
            seat = {p: int(S.tables_drawn(one(c, int), one(weak + d1 * (t[p[0]] - seat[p])), one(parent(p[1])), d1, seeds[p], place)[0]) for p, c in pairs.items()}
            k, t = Counter(), Counter()
            for (u, w), x in seat.items():
                k[w] += x
                t[u] += x
            others = strong + d0 * max(0, r.total() - 1)
            r = Counter({w: int(S.tables_drawn(one(c, int), one(others), one(1 / (v + 1)), d0, named(w).reshape(1), place)[0]) for w, c in k.items()})
        chances.append(lambda u, w, t=t, seat=seat, parent=parent: (max(0, pairs[u, w] - d1 * seat.get((u, w), 0)) + (weak + d1 * t[u]) * parent(w)) / (weak + context[u]))
    chance = lambda u, w: sum(c(u, w) for c in chances) / chains
    out = []
    for i, text in rows:
        words = tokens(text)
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words)
        score = sum(math.log10(chance(u, w)) for u, w in pairwise(["", *words]))
        out.append((i, len(words), sum(seen[w] > 0 for w in words), n, base, score))
    return out, chance, seen


def found(df, **how):
    return [tuple(r) for r in S.scored(df, F.col("doc_id") % 7 != 2, **how).select("id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[5]))
    assert len(got) == len(want)
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-9, rel=1e-9)


def corpus():
    r = np.random.default_rng(4)
    vocabulary = ["the", "Of", "an", "of", "é", "ÉÀ", "x" * 40, "a,b", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(vocabulary[min(int(r.zipf(1.4)) - 1, len(vocabulary) - 1)] for _ in range(n))
    rows = [(i, text(int(r.integers(0, 60)))) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(30)]  # copies: a third of the rows
    return [*rows, (7, None), (9, ""), (9, " \t\n"), (9, " \t\n"), (16, "unseen  words\x0bhere\x00too the"), (None, "the of"), (70, "the of " * 300), (72, "new " * 20)]


@pytest.fixture(scope="module")
def plainly():
    return plain(corpus())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("parts", "tokens", "bucket"), [(1, S.BLOCK_TOKENS, S.PAIRS), (4, 97, 50), (2, 1, 400)])
def test_equals_plain_model_however_it_is_cut(spark, plainly, monkeypatch, parts, tokens, bucket):
    rows = corpus() if tokens > 1 else corpus()[:12]
    want = plainly[0] if tokens > 1 else plain(rows)[0]
    monkeypatch.setattr(S, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(S, "PAIRS", bucket)
    monkeypatch.setattr(S, "WORDS", bucket)
    same(found(frame(spark, rows, parts)), want)


def test_probabilities_sum_to_one(plainly):
    _, chance, seen = plainly
    for context in ("", "the", "of", "w3", "never seen"):
        assert sum(chance(context, w) for w in [*seen, "never seen"]) == pytest.approx(1)


def test_empty_and_nothing_to_learn(spark):
    assert found(frame(spark, [])) == []
    same(found(frame(spark, [(2, "a b"), (9, None)])), [(2, 3, 0, 0, 0.0, 0.0), (9, 1, 0, 0, 0.0, 0.0)])


def test_tables_follow_their_conditional():
    d, weight, chance, c, n = 0.6, 2.5, 0.3, 5, 200_000
    weights = {}

    def seat(sizes, left, w):
        if not left:
            weights[len(sizes)] = weights.get(len(sizes), 0) + w
            return
        for i, s in enumerate(sizes):
            seat([*sizes[:i], s + 1, *sizes[i + 1 :]], left - 1, w * (s - d))
        seat([*sizes, 1], left - 1, w * (weight + d * len(sizes)) * chance)

    seat([1], c - 1, weight * chance)
    drawn = S.tables_drawn(np.full(n, c), np.full(n, weight), np.full(n, chance), d, S.mixed(np.arange(n, dtype=np.uint64)), 3)
    total = sum(weights.values())
    for t, w in weights.items():
        assert (drawn == t).mean() == pytest.approx(w / total, abs=0.005)
    many = S.tables_drawn(np.full(500, 3000), np.full(500, 50.0), np.full(500, 0.05), d, S.mixed(np.arange(500, dtype=np.uint64)), 1)
    assert (many >= 1).all() and (many < 300).all() and 5 < many.mean() < 150


def test_tokens_and_packing():
    texts = ["", "A b", " lead", "trail ", "é x y", "one\x1ctwo", "", "x" * 5000, "b a"]
    got, lengths = S.tokens_of(pa.array(texts))
    want = [tokens(t) for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert got.tolist() == [int(named(w)) for t in want for w in t]
    part, n = S.tokens_of(pa.array(texts).slice(1, 3))
    assert part.tolist() == [int(named(w)) for t in want[1:4] for w in t] and n.tolist() == [3, 2, 2]
    for values in (np.zeros(0, np.int64), np.array([1, -5, 1 << 62]), np.arange(1000)):
        assert S.unpacked(S.packed(values)).tolist() == values.tolist()


def test_long_words_hash_by_pieces(monkeypatch):
    data = np.frombuffer(b"abcdefghij klm nopqrstuvwxyz0123456789", np.uint8)
    starts, ends = np.array([0, 11, 15]), np.array([10, 14, 38])
    want = S.word_hashes(data, starts, ends)
    powers = S._powers()
    monkeypatch.setattr(S, "SLICE", 4)
    monkeypatch.setattr(S, "_powers", lambda: (powers[0][:5], powers[1][:5]))
    assert S.word_hashes(data, starts, ends).tolist() == want.tolist()


def test_beats_the_base_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = queries()["op12_scoring"](spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got.count() == len(rows)
    sums = got.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] > 0.9 * sums[1] and 10 ** (-sums[0] / sums[2]) < 0.4 * 10 ** (-sums[1] / sums[2])
