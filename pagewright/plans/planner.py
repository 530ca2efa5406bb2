"""Section plans and routes by fixed rules, in place of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS

# cue words of the routes and of questions about a whole document
REASON_CUES = ("why", "how", "compare", "summarize", "summarise", "explain", "contradiction", "trend", "overall", "strategy", "relationship")
LOOKUP_CUES = ("page", "where", "find", "exact", "quote", "value", "number", "date", "locate", "mention")
WHOLE_CUES = r"\b(all|entire|contradictions?|executive summary|whole)\b"


def terms(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3))


def route(questions: DataFrame) -> DataFrame:
    """``route`` of each question by the number of cues, ties to lookup, and
    ``failover``, the route to take if that finds nothing."""
    words = F.split(F.lower("question"), r"[^\p{L}]+")
    hits = lambda cues: F.size(F.array_intersect(words, F.array(*map(F.lit, cues))))
    chosen = F.when(hits(REASON_CUES) > hits(LOOKUP_CUES), "reason").otherwise("lookup")
    return questions.withColumn("route", F.coalesce(chosen, F.lit("lookup"))).withColumn("failover", F.when(F.col("route") == "reason", "lookup").otherwise("reason"))


def plan(questions: DataFrame, sections: DataFrame, limit: int = SETTINGS.plan_tasks) -> DataFrame:
    """Tasks (question_id, doc_id, task_no, section_name, sub_query, score): the
    sections of the question's document with most of its terms in name and
    summary; questions about the whole document and documents without sections
    get no task. The join is on document and term, then counted."""
    asked = questions.where(~F.lower("question").rlike(WHOLE_CUES)).select("question_id", "doc_id", "question", F.explode(terms("question")).alias("term"))
    named = sections.select("doc_id", "section_name", F.explode(terms(F.concat_ws(" ", "section_name", "summary"))).alias("term"))
    scored = asked.join(named, ["doc_id", "term"]).groupBy("question_id", "doc_id", "question", "section_name").agg(F.count_distinct("term").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "section_name")
    return scored.withColumn("task_no", F.row_number().over(order)).where(F.col("task_no") <= limit).select("question_id", "doc_id", "task_no", "section_name", F.col("question").alias("sub_query"), "score")


def capped(tasks: DataFrame, limit: int = SETTINGS.plan_tasks) -> DataFrame:
    """the first tasks of each plan, before they are checked."""
    order = Window.partitionBy("question_id").orderBy("task_no")
    return tasks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def valid_tasks(tasks: DataFrame, sections: DataFrame, limit: int = SETTINGS.plan_tasks) -> DataFrame:
    """Tasks within the cap whose section there is."""
    return capped(tasks, limit).join(sections.select("doc_id", "section_name"), ["doc_id", "section_name"], "left_semi")


def dropped_tasks(tasks: DataFrame, sections: DataFrame, limit: int = SETTINGS.plan_tasks) -> DataFrame:
    """The others within the cap."""
    return capped(tasks, limit).join(sections.select("doc_id", "section_name"), ["doc_id", "section_name"], "left_anti")
