"""Payloads in chat messages and the precedence of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# fixed values: the keys of a run's input
KEYS = ("run_id", "user_id", "question", "document_id", "pageindex_doc_id")


def payload(text: Column | str, keys=KEYS) -> Column:
    """The JSON object a message consists of, if it has one of the
    known keys; else null."""
    text = X.strip(text)
    looks = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    known = F.arrays_overlap(F.json_object_keys(text), F.array(*map(F.lit, keys)))
    return F.when(looks & F.try_parse_json(text).isNotNull() & known, text)


def run_inputs(messages: DataFrame, settings: dict[str, str | None] | None = None, text: str = "text", role: str = "role") -> DataFrame:
    """C14: the run input of each user message: the payload's value, else the
    setting, else for the question the message itself."""
    settings = settings or {}
    body = F.when(F.col(role) == "user", payload(text))
    out = messages.withColumn("_p", body)
    value = lambda key: F.coalesce(F.get_json_object("_p", f"$.{key}"), F.lit(settings.get(key)).cast("string"))
    out = out.withColumns({key: value(key) for key in KEYS if key != "question"})
    question = F.coalesce(F.get_json_object("_p", "$.question"), F.when(F.col("_p").isNull(), F.col(text)))
    guard = F.when(F.col("document_id").isNull(), F.lit("error: no document_id"))  # B13
    return out.withColumn("question", question).withColumn("error", guard).withColumn("is_payload", F.col("_p").isNotNull()).drop("_p")
