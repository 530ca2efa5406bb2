from pagewright.llm._shared import labelled_texts, training_rows


def test_repeated_keys_do_not_fill_the_sample(spark):
    rows = [(1, "one", "en")] * 70 + [(n, f"text {n}", "fr") for n in range(2, 40)] + [(None, "none", "de")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted([("one", "en"), *((f"text {n}", "fr") for n in range(2, 40))])
    assert sorted(training_rows(docs, docs, "doc_id", "text", "lang", 39)) == want
    assert sorted(labelled_texts(docs, "doc_id", "text", "lang", 39)) == want
    assert len(training_rows(docs, docs, "doc_id", "text", "lang", 10)) == len(labelled_texts(docs, "doc_id", "text", "lang", 10)) == 10


def test_texts_keep_their_own_labels(spark):
    rows = [(1, "english text", "en"), (1, "texte francais", "fr"), (2, "two", "en"), (3, None, "de"), (3, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(labelled_texts(docs, "doc_id", "text", "lang", 10)) == [("", "de"), ("english text", "en"), ("texte francais", "fr"), ("two", "en")]
    # of two texts under a key no label of another table tells which it means
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    assert training_rows(docs, labels, "doc_id", "text", "toxic", 10) == [("two", 1)]


def test_bytes_are_bounded(spark):
    docs = spark.createDataFrame([(n, "x" * 100, "en") for n in range(20)], "doc_id long, text string, lang string")
    assert len(training_rows(docs, docs, "doc_id", "text", "lang", 20, 550)) == 5
    assert len(labelled_texts(docs.withColumn("text", docs.doc_id.cast("string")), "doc_id", "text", "lang", 20, 0)) == 0


def test_one_key_of_many_texts_is_cut_before_its_texts_move(spark):
    rows = [(1, f"text {i} " + "x" * 1000, "en") for i in range(3000)] + [(2, "zwei", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    got = labelled_texts(docs, "doc_id", "text", "lang", 50, 20_000)
    assert 1 <= len(got) <= 20 and got == labelled_texts(docs.repartition(2), "doc_id", "text", "lang", 50, 20_000)
