import corpus_pipeline as pipeline


def test_without_a_model_texts_with_a_letter_stay(spark, tmp_path):
    rows = [(1, "words", None, "s", 5), (2, "12 !?", None, "s", 5), (3, None, None, "s", 0), (4, "é", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in pipeline.identify_language(spark, df, str(tmp_path)).collect()} == {1, 4}


def test_numbers_are_no_letters(spark):
    from pyspark.sql import functions as F

    from pagewright.llm import language

    learn = spark.createDataFrame([(i, w * 20, lang) for i, (w, lang) in enumerate([("the and of ", "en"), ("der und die ", "de")] * 10)], "doc_id long, text string, lang string")
    net = language.fit(learn)
    odd = [(0, "²"), (1, "½ 12"), (2, "①Ⅳ"), (3, "ª"), (4, "_ 7"), (5, "a"), (6, "語")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string"), net).collect()}
    assert {k for k, v in got.items() if v == "und"} == {0, 1, 2, 4}
    (kept,) = spark.createDataFrame(odd, "doc_id long, text string").where(F.col("text").rlike(r"\p{L}")).select(F.sort_array(F.collect_set("doc_id"))).first()
    assert kept == [3, 5, 6]
