import itertools
import random

import numpy as np
import xxhash

from pagewright.llm import components, simhash


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks(3)
    for places in itertools.combinations(range(64), 3):
        flipped = sum(1 << p for p in places)
        assert any(flipped & m == 0 for m in masks)


def test_fingerprint_by_definition():
    text = "The QUICK brown fox\tjumps over É the the the"
    words = [w for w in text.translate(simhash.LOWER).replace("\t", " ").split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def classes(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_links_give_the_classes_of_all_pairs(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:20]:  # chains and dense groups around some values
        for _ in range(8):
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    values = sorted(set(values))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    # 5: buckets are dealt into many parts; 3: keys of over three rows are broadcast
    for block, hot in ((2048, 100_000), (5, 3)):
        found = {r.node: r.root for r in components.components(simhash.links(fps, 3, block, hot), hot=hot).collect()}
        group = classes(values, 3)
        for i, j in itertools.combinations(range(len(values)), 2):
            same = found.get(signed[i], i) == found.get(signed[j], j) and signed[i] in found
            assert same == (group[i] == group[j])


def test_rows_nulls_and_repeats(spark):
    long = " ".join(f"word{i % 50}" for i in range(30_000))
    rows = [(5, "alpha beta gamma delta", "x"), (3, "Alpha BETA gamma delta", "y"), (3, "Alpha BETA gamma delta", "y"), (9, None, None), (7, "", "z"), (None, "alpha beta gamma delta", "n"), (11, long, "l"), (None, "lonely words with no id", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 7), (7, 7), (None, 3), (11, 11), (None, None)], key=str)
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 500), (600, 601), (None, 3)], "a int, b int")
    for hot in (100_000, 1):
        got = {r.node: r.root for r in components.components(edges, hot=hot).collect()}
        assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 600, 601: 600}
