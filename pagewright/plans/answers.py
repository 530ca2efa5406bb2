"""Composite queries: what the agents' tools find for a question, in batch.

Evidence is lines of the question's document that share its terms, with page
and line. A lookup searches the whole document or given pages (J7, J9), a
reasoning question its planned sections (J5, J8); a document question reads the
records of all chapters (J6). Which of these answers is decided by the route,
and a route that finds nothing fails over to the other (K7, K10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..lineage import cut
from ..operators.grep import matched_lines
from ..operators.pages import page_map
from . import planner

#: terms of questions that are broadcast
BROADCAST = 100_000
#: different terms of all questions by which lines are chosen before they move
VOCABULARY = 10_000


def _sought(asked: DataFrame, *keys: str, question: str = "question") -> DataFrame:
    """The terms of each key's questions, as an array ``_terms``."""
    terms = F.array_distinct(F.flatten(F.collect_list(planner.terms(question)))).alias("_terms")
    return asked.groupBy(*keys).agg(terms).where(F.size("_terms") > 0)


def _lines_with(pages: DataFrame, words: list[str] | None) -> DataFrame:
    """Lines as an array ``_lines`` of their page, each with its terms that are
    among ``words``; a line that has none of them is no evidence and goes no
    further. Without ``words`` every line stays, with all its terms to be found."""
    lines = matched_lines(pages)
    if words is None:
        return lines
    held = F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), F.filter(planner.terms(x["text"]), lambda w: w.isin(words)).alias("terms")))
    return lines.withColumn("_lines", F.filter(held, lambda x: F.size(x["terms"]) > 0))


def _evidence(sought: DataFrame, pages: DataFrame, keys: list[str], on: list[str], limit: int) -> DataFrame:
    """An equi-join of pages and ``sought`` terms on document (or printed page).
    Lines stay arrays of their page and are scored there; a page gives its best
    lines only, so what is exploded and ranked is no more than the evidence. What
    is sought is worked out and written once. Its different terms, if few, choose
    the lines before these move; it is broadcast if it is small, by count, else
    both sides meet by key."""
    sought = cut(sought)
    few = sought.agg(F.count("*"), F.sum(F.size("_terms"))).first()
    words = [r[0] for r in sought.select(F.explode("_terms").alias("w")).distinct().limit(VOCABULARY + 1).collect()]
    if "printed_page" in on:
        sought = sought.join(page_map(pages), on).drop("printed_page")
        on = ["physical_page" if c == "printed_page" else c for c in on]
    side = F.broadcast(sought) if few[0] <= BROADCAST and (few[1] or 0) <= BROADCAST else sought.hint("merge")
    chosen = len(words) <= VOCABULARY
    score = lambda x: F.size(F.array_intersect(x["terms"] if chosen else planner.terms(x["text"]), "_terms")).cast("long")
    each = F.transform("_lines", lambda x: F.struct((-score(x)).alias("score"), x["line"].alias("line"), x["text"].alias("text")))
    best = F.slice(F.sort_array(F.filter(each, lambda x: x["score"] < 0)), 1, max(limit, 0))
    met = _lines_with(pages, words if chosen else None).join(side, on).select(*dict.fromkeys([*keys, "doc_id"]), "printed_page", "physical_page", F.explode(best).alias("_x"))
    found = met.select("*", F.col("_x.line").alias("line"), F.col("_x.text").alias("text"), (-F.col("_x.score")).alias("score")).drop("_x")
    # a line that is there twice has one place
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "line", "doc_id", "physical_page", "printed_page", "text")
    return found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= limit).dropDuplicates()


def lookup(questions: DataFrame, pages: DataFrame, limit: int = SETTINGS.grep_limit) -> DataFrame:
    """The best lines of each question's document. A question may name
    printed pages (column ``pages_filter``: null or empty means all)."""
    keys, on = ["question_id"], ["doc_id"]
    if "pages_filter" not in questions.columns:
        return _evidence(_sought(questions, *keys, *on), pages, keys, on, limit)
    narrow = questions.where(F.coalesce(F.size("pages_filter"), F.lit(0)) > 0)
    scope = narrow.select(*keys, *on, "question", F.explode("pages_filter").alias("printed_page"))
    wide = questions.where(F.coalesce(F.size("pages_filter"), F.lit(0)) <= 0)
    by_page = [*on, "printed_page"]
    return _evidence(_sought(wide, *keys, *on), pages, keys, on, limit).unionByName(_evidence(_sought(scope, *keys, *by_page), pages, keys, by_page, limit))


def section_workers(tasks: DataFrame, pages: DataFrame, sections: DataFrame, limit: int = SETTINGS.grep_limit) -> DataFrame:
    """The best lines of each task within its section's pages; sections that
    don't exist or have no page give no line (B16)."""
    scope = sections.select("doc_id", "section_name", F.explode("pages").alias("printed_page")).distinct()
    asked = _sought(tasks, "question_id", "section_name", "doc_id", question="sub_query")
    return _evidence(asked.join(scope, ["doc_id", "section_name"]), pages, ["question_id", "section_name"], ["doc_id", "printed_page"], limit)


def document_agent(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter records that share terms with a question, best first; all
    chapters for a question about the whole document."""
    whole = F.lower("question").rlike(planner.WHOLE_CUES)
    named = chapters.select("doc_id", "chapter_name", "summary", F.explode(planner.terms(F.concat_ws(" ", "chapter_name", "summary"))).alias("term"))
    some = questions.where(~whole).select("question_id", "doc_id", F.explode(planner.terms("question")).alias("term")).join(named, ["doc_id", "term"])
    some = some.groupBy("question_id", "doc_id", "chapter_name", "summary").agg(F.count_distinct("term").alias("score"))
    every = questions.where(whole).select("question_id", "doc_id").join(chapters.select("doc_id", "chapter_name", "summary"), "doc_id")
    return some.unionByName(every.withColumn("score", F.lit(0).cast("long")).select(*some.columns))


def answers(questions: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Evidence of each question by its route, or by the other one if
    that finds nothing: question_id, route (the one that found it), doc_id,
    printed_page, physical_page, line, text, score."""
    routed = planner.route(questions)
    # plan, check of the plan and workers read the sections
    sections = cut(sections.select("doc_id", "section_name", "summary", "pages"))
    columns = ["question_id", "doc_id", "printed_page", "physical_page", "line", "text", "score"]
    by_lookup = lookup(routed, pages).select(*columns)
    tasks = planner.valid_tasks(planner.plan(routed, sections), sections)
    by_reason = section_workers(tasks, pages, sections).groupBy(*columns[:-1]).agg(F.max("score").alias("score"))
    both = by_lookup.withColumn("by", F.lit("lookup")).unionByName(by_reason.withColumn("by", F.lit("reason")))
    found = both.join(routed.select("question_id", "route"), "question_id")
    hit = F.max((F.col("by") == F.col("route")).cast("int")).over(Window.partitionBy("question_id"))
    return found.withColumn("_hit", hit).where((F.col("by") == F.col("route")) | (F.col("_hit") == 0)).select("question_id", F.col("by").alias("route"), *columns[1:])
