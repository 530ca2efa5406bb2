import corpus_pipeline as pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    assert pipeline.run(spark, SF).count() == counts[-1]


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stage_edge_cases(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string"
    rows = [(1, "some plain words here", "en", "s", 21, "x", "y"), (1, "some plain words here", "en", "s", 21, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", None, 0, None, None), (None, "words of no id at all", None, "s", None, None, None), (4, "long words " * 20_000, "en", "s", 1, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = {r.doc_id for r in stage(spark, df, SF).collect()}
    assert {1, None, 4} <= out
    assert stage(spark, df.where("false"), SF).count() == 0


def plain_run():
    """The stages over documents by plain definitions."""
    import hashlib
    import re

    import duckdb
    import public_tokenizers
    import tiktoken

    from pagewright.llm import bpe, simhash
    from tests.llm.test_secrets import base

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    items = [t.lower() for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    docs = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    # the stage's contract: five-word shingles, a similarity of 0.8 or more
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(simhash.LOWER)) for _, t in docs]
    sets = [{" ".join(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 1000 * len(sets[i] & sets[j]) >= 800 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = [d for n, d in enumerate(docs) if root[n] == n]
    docs = [(i, t) for i, t in docs if not any(x in t.lower() for x in items)]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {}
    for i, t in docs:
        kept, at = "", 0
        for start, _, end in base(t):
            if start >= at:
                kept += t[at:start] + "[SECRET]"
            at = max(at, end)
        kept += t[at:]
        ids = encoding.encode_ordinary(kept)
        out[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_run_equals_plain_definitions(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()}
    assert got == plain_run()
