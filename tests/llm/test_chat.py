import hashlib

from pagewright.llm import chat


def talk(conv, *turns):
    return [(conv, n, role, text, "x") for n, (role, text) in enumerate(turns)]


def test_prefixes_and_copies_go(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes?"), ("user", "bye")
    rows = talk(1, a) + talk(2, a, b) + talk(3, a, b, c) + talk(9, a, b, c) + talk(4, a, c) + talk(5, ("user", None), (None, "")) + talk(None, ("user", "no id")) + [(7, 1, "user", "twin", "x"), (7, 1, "user", "twin", "x"), (8, None, "user", "hi", "x"), (8, 0, "assistant", "other", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(3)
    got = {r.conv_id: r for r in chat.render(chat.maximal(df)).collect()}
    assert set(got) == {3, 4, 5, None, 7, 8}
    assert got[3].n_copies == 2
    assert got[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes?<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert len(got[7].turns) == 2 and got[8].turns[0].text == "hi"
    assert chat.maximal(df.where("false")).count() == 0


def test_joined_text_is_unambiguous(spark):
    rows = talk(1, ("user", "a"), ("user", "b")) + talk(2, ("user", "a1:b")) + talk(3, ("user", "a"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, z string")
    assert {r.conv_id for r in chat.maximal(df).collect()} == {1, 2}


def test_rows_without_an_id_stand_alone(spark):
    rows = [(None, 1, "user", "same"), (None, 2, "user", "same"), (None, 3, "user", "other"), (5, 1, "user", "same"), (6, 1, "user", "first"), (6, 2, "user", "second"), (None, 9, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, len(r.turns), r.turns[0].text, r.n_copies) for r in chat.maximal(df).collect()), key=str)
    assert got == sorted([(5, 1, "same", 3), (6, 2, "first", 1), (None, 1, "other", 1)], key=str)


def test_long_conversations_hash_like_the_plain_loop(spark):
    said = [("user" if n % 2 else "assistant", f"turn {n} é🙂" * (n % 3)) for n in range(3000)]
    rows = talk(1, *said) + talk(2, *said[:2999]) + talk(3, *said[:1280]) + talk(4, *said[:1281], ("user", "x" * 300_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, z string").repartition(3)
    last, want = "", []
    for role, text in said:
        last = hashlib.sha256(f"{last}:{len(role)}:{role}{len(text)}:{text}".encode()).hexdigest()
        want.append(last)
    assert chat.snapshots(df).where("conv_id = 1").first().hashes == want
    assert {r.conv_id: len(r.turns) for r in chat.maximal(df).collect()} == {1: 3000, 4: 1282}
