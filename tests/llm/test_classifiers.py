import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from pagewright.llm import language, quality, toxicity


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_language_on_held_out_texts(spark):
    rng = random.Random(6)
    kinds = {"aa": "abcde", "bb": "xyzwé", "cc": "mnopq"}
    samples = [(words(rng, kinds[k], rng.randint(5, 200)), k) for k in kinds for _ in range(60)]
    net = language.train(samples)
    tests = [(words(rng, kinds[k], 40), k) for k in kinds for _ in range(20)]
    rows = [(i, t, k) for i, (t, k) in enumerate(tests)] + [(900, None, "aa"), (901, "", None), (902, "12 !?", "aa"), (903, words(rng, "abcde", 30_000), "aa")]
    df = spark.createDataFrame(rows, "doc_id int, text string, score string")
    got = {r.doc_id: r for r in language.predict(df, net).collect()}
    assert sum(got[i].lang_pred == k for i, (_, k) in enumerate(tests)) >= 57
    assert all((got[n].lang_pred, got[n].score) == ("und", 0.0) for n in (900, 901, 902))
    assert got[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert language.fit(df.where("false").withColumnRenamed("score", "lang")) is None
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(7)

    def text(label):
        out = words(rng, "abcdefg", rng.randint(20, 200)).split(" ")
        for _ in range(3 * label):
            out.insert(rng.randrange(len(out)), rng.choice(["vileword", "nastyterm"]))
        return " ".join(out)

    model = toxicity.train([(text(i % 2), i % 2) for i in range(200)])
    rows = [(i, text(i % 2), 1) for i in range(60)] + [(100, None, 1), (101, "", 1), (102, "a", None), (103, text(1) + words(rng, "abcdefg", 20_000), 1)]
    got = {r.doc_id: r.score for r in toxicity.predict(spark.createDataFrame(rows, "doc_id int, text string, score int"), model).collect()}
    assert sum((got[i] >= toxicity.THRESHOLD) == (i % 2 == 1) for i in range(60)) >= 58
    assert got[100] == got[101] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.train([]).score("x") < 1e-3 and toxicity.train([("a", 1)]).score("x") > 0.99
    assert toxicity.predict(spark.createDataFrame([], "doc_id int, text string"), model).count() == 0


def test_quality_grades_are_in_order(spark):
    rng = random.Random(8)

    def text(grade):
        out = words(rng, "abcdefg", 60)
        return out if grade == 2 else out.replace(" ", " ### ") if grade == 0 else out.upper()

    model = quality.train([(text(g), g * 10) for g in (0, 1, 2) for _ in range(60)])
    assert list(model.cuts) == sorted(model.cuts) and model.grades == [0, 10, 20]
    rows = [(i, text(i % 3), "x") for i in range(60)] + [(100, None, None), (101, "", "x"), (102, text(2) * 500, "x")]
    got = {r.doc_id: r for r in quality.predict(spark.createDataFrame(rows, "doc_id int, text string, tails string"), model).collect()}
    assert sum(round(got[i].expected_grade / 10) == i % 3 for i in range(60)) >= 54
    assert all(r.tails[0] >= r.tails[1] for r in got.values()) and got[100].expected_grade == got[101].expected_grade
    assert quality.train([]) is None and quality.train([("a", 4)]).grades == [4]
    assert {r.expected_grade for r in quality.predict(spark.createDataFrame([(1, "a")], "doc_id int, text string"), None).collect()} == {None}


def test_responses_are_a_plain_convolution():
    rng = np.random.default_rng(5)
    net = language.train([("abc def " * 20, "x"), ("uvw xyz " * 20, "y")] * 5)
    windows = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    got = net.pooled(windows, net.tables()).max(1)
    wide = sorted(net.filters, key=len, reverse=True)
    for row, window in enumerate(windows):
        seen, column = net.vectors[window], 0
        for f in wide:
            for k in range(f.shape[2]):
                # a filter that reaches past the window's end sees nothing there
                sums = [sum(float(seen[at + j] @ f[j, :, k]) for j in range(len(f)) if at + j < len(seen)) for at in range(len(seen))]
                assert got[row, column] == pytest.approx(max(sums), abs=1e-3)
                column += 1


def test_toxicity_weights_are_scaled_by_plain_counts(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    samples = [(words(rng, "abc", 8) + (" nastyterm" if n % 2 else ""), n % 2) for n in range(40)]
    model = toxicity.train(samples)
    holds = {int(b): [0, 0] for t, _ in samples for b in toxicity.features(t)}
    for t, y in samples:
        for b in toxicity.features(t):
            holds[int(b)][y] += 1
    ratio = {b: math.log((p + 0.5) / 21) - math.log((n + 0.5) / 21) for b, (n, p) in holds.items() if p + n >= toxicity.LEAST_TEXTS}
    assert set(model.buckets.tolist()) == {b for b, r in ratio.items() if r >= toxicity.LEAST_RATIO}
    # after one step of a given length each coefficient is the same, so weights go like ratios
    steps = {round(w / ratio[b], 6) for b, w in zip(model.buckets.tolist(), model.weights, strict=True)}
    assert len(steps) == 1 and steps.pop() > 0


def test_long_texts_have_the_features_of_the_whole(monkeypatch):
    rng = random.Random(3)
    for n in (1, 7, 40, 300):
        text = words(rng, "abcé", n)
        whole = toxicity.features(text)
        monkeypatch.setattr(toxicity, "PIECE", 16)
        assert toxicity.features(text).tolist() == whole.tolist()
        monkeypatch.undo()


def test_slopes_of_the_ordinal_likelihood():
    rng = np.random.default_rng(6)
    n, m = 30, 8
    rows, place = np.repeat(np.arange(n), 4), rng.integers(0, m, 4 * n)
    sample = quality.Sample(rows, place, rng.normal(size=4 * n), rng.integers(0, 4, n), rng.uniform(0.5, 2, n))
    params = [rng.normal(size=m), rng.normal(size=1), rng.normal(size=2) * 0.3]
    _, slopes = quality.objective(params, sample)
    for p, slope in zip(params, slopes, strict=True):
        for i in range(len(p)):
            ends = []
            for move in (1e-6, -1e-6):
                p[i] += move
                ends.append(quality.objective(params, sample)[0])
                p[i] -= move
            assert slope[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)
    # the likelihood by its plain definition
    z = np.zeros(n)
    for r, c, v in zip(sample.rows, sample.place, sample.values, strict=True):
        z[r] += params[0][c] * v
    cuts = [-math.inf, *quality.cuts_of(params[1], params[2]), math.inf]
    tail = lambda x, t: 1.0 if t == -math.inf else 0.0 if t == math.inf else 1 / (1 + math.exp(t - x))
    plain = [-w * math.log(tail(x, cuts[g]) - tail(x, cuts[g + 1])) for x, g, w in zip(z, sample.y, sample.weight, strict=True)]
    assert quality.objective(params, sample)[0] == pytest.approx(sum(plain) / n + quality.PENALTY * (params[0] @ params[0]) / 2)


def test_the_middle_grade_is_told_apart_on_held_out_documents():
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), quality, toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL").fetchall()
    graded = [(t, 0 if q == 0 else 1 if x == 1 else 2, zlib.crc32(str(i).encode()) % 5 == 3) for i, t, q, x in rows]
    model = quality.train([(t, g) for t, g, held in graded if not held])
    tails = {g: np.array([model.tails(t) for t, h, held in graded if held and h == g]) for g in range(3)}
    assert tails[0][:, 0].mean() < 0.1 and min(tails[1][:, 0].mean(), tails[2][:, 0].mean()) > 0.95
    assert tails[1][:, 1].mean() < 0.55 and tails[2][:, 1].mean() > 0.8
    assert (tails[1][:, 1] < 0.5).mean() >= 0.5 and (tails[2][:, 1] >= 0.5).mean() >= 0.95
