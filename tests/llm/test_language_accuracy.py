"""Language of held-out documents, over the whole query."""

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm.registry import queries

SF = "/root/testdata/sf0.01"


def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    found = queries()["op4_language"](spark, SF)
    both = found.where("held_out").join(docs.where("lang is not null"), "doc_id")
    judged = both.select((F.col("lang_pred") == F.col("lang")).cast("int").alias("hit"), F.length("text").alias("n")).collect()
    long = [r["hit"] for r in judged if r["n"] >= 200]
    assert len(long) > 100 and np.mean(long) >= 0.97
    assert np.mean([r["hit"] for r in judged]) >= 0.93
    assert found.where("score < 0 or score > 1 or lang_pred is null").count() == 0
