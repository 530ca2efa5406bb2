import random

import public_tokenizers
import pytest
import tiktoken

from pagewright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.Tokenizer(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_equals_tiktoken(both):
    mine, theirs, ranks = both
    rng, kinds = random.Random(3), ["abcdefgh", " \n\t", "éèüñ漢字🙂", "0123", "!?.;''s", "thertion"]
    vocabulary = list(ranks)
    for _ in range(2000):
        a = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40)))
        b = b"".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5))).decode("utf-8", "ignore")
        for text in (a, b, "<|endoftext|>" + a):
            assert mine.encode(text) == theirs.encode_ordinary(text)
    for text in ("x" + "therestionz" * 700, "a" * 3000 + "ab" * 900):
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_tokens_leave_before_the_end(both):
    machine = both[0].machine
    long = b"thereisnospaceinthisword" * 400
    assert machine.encode(long) == machine.merge(long[:600])[:100] + machine.encode(long)[100:]


def test_utf8_stream():
    text = "aé漢🙂" * 3
    for size in (1, 2, 3, 5):
        stream, data = bpe.Utf8Stream(), text.encode()
        got = "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.feed(b"", True)
        assert got == text
    broken = bpe.Utf8Stream()
    assert broken.feed(b"a\xf0\x9f") + broken.feed(b"", True) == "a�"


def test_round_trip_of_rows(spark):
    texts = ["Hello  world", "", None, "é🙂 " * 20_000, "Hello  world"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids string").repartition(2)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()}
    for i, text in enumerate(texts):
        assert bytes(got[i].decoded) == (text or "").encode() and got[i].decoded_text == (text or "")
    assert got[1].ids == [] and got[0].ids == got[4].ids
    assert bpe.encode(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert bytes(bpe.decode(nothing, PATH).first().decoded) == b""


def test_one_pass_equals_both_steps(spark):
    rows = [(1, "one two  é漢🙂", "x"), (1, "one two  é漢🙂", "x"), (2, None, None), (3, "", "y"), (None, "words " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(2)
    two = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN).drop("text"), PATH)
    one = bpe.coded(df, PATH, public_tokenizers.PATTERN)
    assert one.columns == two.columns == ["doc_id", "ids", "decoded", "decoded_text"]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert bpe.coded(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
