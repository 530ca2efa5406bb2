import itertools
import random

import corpus_pipeline as pipeline
from pagewright.llm import components, nearcopies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def some_texts():
    rng = random.Random(5)
    out = []
    for _ in range(12):
        words = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(200)]
        out += [words, *(edited(rng, words, rng.randint(1, 12)) for _ in range(4))]
    return out


def test_classes_are_those_of_all_pairs_at_the_threshold(spark):
    found = some_texts()
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(found)], "k int, text string")
    got = {r.k: r.root for r in nearcopies.classes(df, "k").collect()}
    root = list(range(len(found)))
    for i, j in itertools.combinations(range(len(found)), 2):
        if similarity(found[i], found[j]) >= 0.8:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert 12 < len(set(root)) < len(root)
    for i, j in itertools.combinations(range(len(found)), 2):
        assert (got[i] == got[j]) == (root[i] == root[j])


def test_parts_of_a_group_give_the_same_classes(spark):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(some_texts())], "k int, text string")
    nodes = nearcopies.sketches(df, "text", "k")
    sets = nearcopies.sets_of(nodes.join(df, "k"), "text")
    whole, dealt = ({r.node: r.root for r in components.components(nearcopies.links(nearcopies.groups(nodes, n, m, hot), sets)).collect()} for n, m, hot in ((2048, 4 << 20, 100_000), (2, 3000, 2)))
    assert whole == dealt


def test_stage_drops_edited_copies_and_only_those(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(9999)}" for _ in range(300)]
    close, apart = edited(rng, base, 4), edited(rng, base, 20)
    assert similarity(base, close) >= 0.8 > similarity(base, apart)
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in ((4, base), (7, close), (9, apart))]
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == {4, 9}


def test_stage_keeps_a_row_of_each_class_whatever_the_ids(spark):
    rows = [(3, "A"), (5, "A"), (5, "B"), (None, "A"), (None, "C"), (None, "C"), (8, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    for n in (1, 4):
        got = pipeline.drop_near_duplicates(spark, df.repartition(n), "").collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, "A"), (5, "B"), (None, "C"), (8, None)], key=str)


def test_simhash_classes_are_candidates_of_the_stage(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(2000)]
    close = edited(rng, base, 2)
    # the same words with one passage many times over: nearly one fingerprint, other shingles
    passage = [f"p{n}" for n in range(40)]
    padded = [[f"{x}{n}" for n in range(60)] + passage * 60 for x in "ab"]
    held = [" ".join(w) for w in (base, close, *padded)]
    prints = [simhash.fingerprint(t) for t in held]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[2] ^ prints[3]).bit_count() <= 3 and similarity(*padded) < 0.8
    marked = nearcopies.sketches(spark.createDataFrame(list(enumerate(held)), "k int, text string"), "text", "k")
    keys = {}
    for r in nearcopies.simhash_keys(marked).join(marked.select("node", "k").withColumnRenamed("k", "row"), "node").collect():
        keys.setdefault(r.k, set()).add(r.row)
    assert sorted(map(sorted, keys.values())) == [[0, 1], [2, 3]]
    # by SimHash alone the close pair is found, and the pair that only looks alike isn't linked
    df = marked.join(spark.createDataFrame(list(enumerate(held)), "k int, text string"), "k")
    member = nearcopies.groups(df.selectExpr("node", "size", "cast(array() as array<long>) as bands"), more=nearcopies.simhash_keys(marked))
    names = {r.node: r.k for r in marked.collect()}
    assert [{names[r.a], names[r.b]} for r in nearcopies.links(member, nearcopies.sets_of(df, "text")).collect()] == [{0, 1}]
    calls, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: calls.append(1) or plain(*a, **k))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(held)]
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == {0, 2, 3} and calls


def test_classes_seen_by_many_groups_need_few_rounds(spark, monkeypatch):
    rng = random.Random(7)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(9999)}" for _ in range(300)]
        texts += [" ".join(edited(rng, words, n)) for n in (0, 1, 1, 2, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    nodes = nearcopies.sketches(df, "text", "k")
    edges = nearcopies.links(nearcopies.groups(nodes), nearcopies.sets_of(nodes.join(df, "k"), "text"))
    # links of one group are stars: what is tied to a lesser node ties no other
    whole = nearcopies.links(nodes.selectExpr("1L as g", "node"), nearcopies.sets_of(nodes.join(df, "k"), "text")).collect()
    assert len(whole) == 24 and not {r.a for r in whole} & {r.b for r in whole} and all(r.a < r.b for r in whole)
    written, plain = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or plain(df))
    assert len({r.root for r in components.components(edges).collect()}) == 6 and len(written) <= 2
    # stars are done at once, and no round is made to see that nothing changes
    written.clear()
    star = spark.createDataFrame([(1, 5), (5, 1), (7, 1), (4, 4), (9, 8)], "a long, b long")
    assert sorted(map(tuple, components.components(star).collect())) == [(1, 1), (4, 4), (5, 1), (7, 1), (8, 8), (9, 8)] and len(written) == 1


def test_texts_of_one_set_and_several_fingerprints_are_one_node(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(9999)}" for _ in range(40)]
    # the same shingles, some of them more often
    held = [" ".join(base * 2 + base[:4]), " ".join(base * 3 + base[:4]), " ".join(base + base[:20] + base)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(held + held[:1])]
    marked = nearcopies.sketches(spark.createDataFrame([(i, t) for i, t, *_ in rows], "k int, text string"), "text", "k")
    nodes = {r.node for r in marked.collect()}
    found = [tuple(r) for r in nearcopies.groups(marked.unionAll(marked)).collect()]
    assert len(found) == len(set(found)) and {n for _, n in found} <= nodes
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert 0 in got and 1 not in got
