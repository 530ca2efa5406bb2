"""Corpus pipeline: language, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontaminate, language, nearcopies, secrets
from pagewright.llm._shared import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and null texts, are rejected; a null ``lang`` becomes
    the language found.  A low score is no ground to reject: short clean texts
    have one; the network rejects nothing.  If nothing can be learned, every
    text with a letter stays and ``lang`` is left as it is."""
    learn = spark.read.parquet(f"{sf_dir}/documents.parquet").where(~language.held_out("doc_id", 4, 2))
    net = language.fit(learn)
    if net is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs.select(*COLUMNS), net)
    return found.where(F.col("lang_pred") != "und").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: that of least id, null ids last;
    of rows of different texts under this id the one of least digest. SimHash
    classes (three bits, as in ``op2``) and MinHash bands give the candidates, and
    a link is one whose five-word shingles are verified: Jaccard 0.8 or over."""
    # tells rows of different id or text apart, and a null id or text from an empty one
    row = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")))))
    rows = docs.select(*COLUMNS, row.alias("_row"))
    kept = nearcopies.leaders(rows.withColumn("_none", F.col("doc_id").isNull()), "_row", ["_none", "doc_id"])
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their ids; null and empty
    texts hold none, repeated rows are judged each."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.without_leaks(docs.select(*COLUMNS), items)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by a mark and ``n_chars`` follows (null for
    a null text); repeated rows are redacted each."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and of the decoded bytes; a
    null or empty text has none, repeated rows are encoded each."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.coded(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secret_scan", redact_secrets),
    ("bpe_tokens", tokenize),
]

#: trained language scores and edit-tolerant matches are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the
    shared checkpoint folder and read again."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
    return docs
