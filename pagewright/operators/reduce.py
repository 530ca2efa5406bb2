"""Reduction of typed findings: segments to sections, sections to chapters.

Element operators work on flat tables (one row for an element, with the keys of
its group), so a group of any size is aggregated in parts; ``records`` puts all
lists of a record together. Text is compared lower-cased with white space collapsed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import cut

RANKS = ("low", "medium", "high")
# fixed value: a record keeps this many salient quotes
QUOTES = 10


def rank(level: Column | str) -> Column:
    return F.when(X.col(level) == "low", 0).when(X.col(level) == "medium", 1).when(X.col(level) == "high", 2)


def level(number: Column) -> Column:
    return F.when(number == 0, "low").when(number == 1, "medium").when(number == 2, "high")


def gist(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(X.col(text), r"\s+", " ")))


def channels(*branches: DataFrame) -> DataFrame:
    """The outputs of parallel branches put together, row for row; a
    column that a branch lacks is null there."""
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def _best(rows: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def worst_confidence(c: Column | str) -> Column:
    """D7, an aggregate: the lowest level."""
    return level(F.min(rank(c)))


def common_sentiment(c: Column | str) -> Column:
    """D9, an aggregate: mixed if children disagree (or any is mixed and none
    outweighs it), else the most frequent; ties are neutral."""
    c = X.col(c)
    n = {k: F.count_if(c == k) for k in ("positive", "negative", "neutral", "mixed")}
    alone = lambda k: F.greatest(*(n[o] for o in n if o != k)) < n[k]
    return F.when((n["positive"] > 0) & (n["negative"] > 0), "mixed").when(alone("positive"), "positive").when(alone("negative"), "negative").when(alone("mixed"), "mixed").otherwise("neutral")


def distinct_texts(rows: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """Distinct texts of each group, first spelling kept."""
    return _best(rows.where(F.col(text).isNotNull()).withColumn("_g", gist(text)), [*keys, "_g"], [order, text]).drop("_g")


def dedup_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One metric for each name and period, the longest value text first."""
    return _best(rows.withColumn("_g", gist("name")), [*keys, "_g", "time_period"], [F.desc(F.length("value_text")), "value_text", "numeric_value"]).drop("_g")


def dedup_claims(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One claim for each polarity, scope and gist, the longest quote first."""
    return _best(rows.withColumn("_g", gist("text")), [*keys, "polarity", "temporal_scope", "_g"], [F.desc(F.length("supporting_quote")), "supporting_quote", "text"]).drop("_g")


def dedup_decisions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D14."""
    return _best(rows.withColumn("_g", gist("text")), [*keys, "_g"], ["text", "decision_type"]).drop("_g")


def escalate_risks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One risk for each category and gist, with the highest severity; a
    known severity outweighs none."""
    return rows.groupBy(*keys, "risk_category", gist("text").alias("gist")).agg(F.min("text").alias("text"), level(F.max(rank("severity"))).alias("severity"), F.count("*").alias("n_merged"))


def metric_conflicts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One name, period and unit with several values."""
    known = rows.where(F.col("numeric_value").isNotNull())
    found = known.groupBy(*keys, gist("name").alias("name"), "time_period", "unit").agg(F.count_distinct("numeric_value").alias("n_values"), F.min("numeric_value").alias("low"), F.max("numeric_value").alias("high"))
    return found.where("n_values > 1")


def merge_contradictions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Carried contradictions (description, statements, supporting_quotes);
    of the same description the statements and quotes are united, in order."""
    grouped = rows.groupBy(*keys, gist("description").alias("_g")).agg(
        F.min("description").alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("statements", "supporting_quotes"))))).alias("_p"),
    )
    return grouped.withColumn("statements", F.col("_p.statements")).withColumn("supporting_quotes", F.col("_p.supporting_quotes")).drop("_g", "_p")


def entity_labels(entities: DataFrame) -> DataFrame:
    """(_k, me, label) of entities (_k, the group as one struct; me; all, the
    spellings): entities of a group that share a spelling, directly or over
    others, have the same label, the least ``me`` among them.

    Names spread to the least label through shared names until nothing changes;
    each round is a few aggregations whose result is written to the shared
    folder, and groups are never gathered in one task. As the group is a struct,
    null keys within it are equal to each other."""
    link = entities.select("_k", "me", F.explode("all").alias("spelling")).select("_k", "me", gist("spelling").alias("key")).distinct()
    label = link.select("_k", "me", F.col("me").alias("label")).distinct()
    last = None
    while True:
        by_key = link.join(label, ["_k", "me"]).groupBy("_k", "key").agg(F.min("label").alias("label"))
        near = link.join(by_key, ["_k", "key"]).groupBy("_k", "me").agg(F.min("label").alias("label"))
        # and on to the label of that label, so that rounds follow the logarithm of a chain
        over = near.select("_k", F.col("me").alias("label"), F.col("label").alias("_far"))
        label = cut(near.join(over, ["_k", "label"], "left").select("_k", "me", F.least("label", "_far").alias("label")))
        mark = label.agg(F.count("*"), F.sum(F.xxhash64("me", "label").cast("decimal(38,0)"))).first()
        if mark == last:
            return label
        last = mark


def merge_entities(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities (name, aliases) that share a name or alias, directly or over
    others, become one: the longest name, all others as sorted aliases.

    Null keys are groups like others; an entity without a name goes by its first
    alias, one without either is none; an empty table gives no row."""
    spelled = F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda s: s.isNotNull() & (gist(s) != ""))
    base = rows.select(F.struct(*keys).alias("_k"), F.array_distinct(spelled).alias("all")).where(F.size("all") > 0).withColumn("me", gist(F.get("all", F.lit(0))))
    label = entity_labels(base)
    spelling = base.select("_k", "me", F.explode("all").alias("spelling")).distinct()
    grouped = spelling.join(label, ["_k", "me"]).groupBy("_k", "label").agg(F.collect_set("spelling").alias("_s"))
    best = F.array_max(F.transform("_s", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    return grouped.withColumn("name", best).select("_k.*", "name", F.array_sort(F.filter("_s", lambda s: s != F.col("name"))).alias("aliases"))


def enumerated(rows: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct element of a document over all its chapters."""
    return rows.groupBy("doc_id", gist(text).alias("gist")).agg(F.min(text).alias(text), F.count("*").alias("n"), F.array_sort(F.collect_set("chapter_name")).alias("chapters"))


def unconfirmed(rows: DataFrame) -> DataFrame:
    """Records whose levels or required fields are out of the schema, with
    the reasons; the others are valid."""
    bad = F.filter(
        F.array(
            F.when(F.coalesce(~F.col("ocr_confidence").isin(*RANKS), F.lit(True)), F.lit("ocr_confidence")),
            F.when(F.coalesce(~F.col("sentiment").isin("positive", "negative", "neutral", "mixed"), F.lit(True)), F.lit("sentiment")),
            F.when(F.col("summary").isNull(), F.lit("summary")),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.withColumn("errors", bad)


def error_digest(errors: Column | str) -> Column:
    """F8: the first three errors and how many more there are."""
    errors = X.col(errors)
    more = F.size(errors) - 3
    return F.concat(F.array_join(F.slice(errors, 1, 3), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


TEXTS = ("topics", "salient_quotes", "notable_other")


def section_bases(analyses: DataFrame) -> DataFrame:
    """What a section record has beside its lists."""
    named = analyses.withColumn("section_name", F.coalesce("section_name", F.lit(""))).withColumn("_at", F.struct("seg_no"))
    return named.groupBy("doc_id", "section_name").agg(
        F.coalesce(F.min_by("chapter_name", "seg_no"), F.lit("")).alias("chapter_name"),
        _pages().alias("pages"),
        _ordered("seg_id").alias("segment_ids"),
        *_merged(),
    )


def chapter_bases(sections: DataFrame) -> DataFrame:
    """What a chapter record has beside its lists."""
    named = sections.withColumn("chapter_name", F.coalesce("chapter_name", F.lit(""))).withColumn("_at", section_place())
    return named.groupBy("doc_id", "chapter_name").agg(_pages().alias("pages"), _ordered("section_name").alias("section_names"), *_merged())


def section_place() -> Column:
    """Sections stand by their least page, those without pages last."""
    return F.struct(F.coalesce(F.array_min("pages"), F.lit(1_000_000_000)).alias("page"), F.col("section_name"))


def reduce_sections(analyses: DataFrame, quotes: int = QUOTES) -> DataFrame:
    """Segment analyses to section records (D1, D3, D4, D6-D10, D17). Of the
    distinct quotes of a record the first ``quotes`` stay: its salient ones;
    topics and other notable texts all stay."""
    named = analyses.withColumn("section_name", F.coalesce("section_name", F.lit(""))).withColumn("_at", F.struct("seg_no"))
    return _with_texts(section_bases(analyses), named, ["doc_id", "section_name"], quotes)


def reduce_chapters(sections: DataFrame, quotes: int = QUOTES) -> DataFrame:
    """Section records to chapter records."""
    named = sections.withColumn("chapter_name", F.coalesce("chapter_name", F.lit(""))).withColumn("_at", section_place())
    return _with_texts(chapter_bases(sections), named, ["doc_id", "chapter_name"], quotes)


def _pages() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("pages", F.array().cast("array<int>"))))))


def _ordered(what: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(what).alias("v")))), lambda x: x["v"])


def _merged() -> list[Column]:
    return [
        worst_confidence("ocr_confidence").alias("ocr_confidence"),
        F.coalesce(F.bool_or("has_table"), F.lit(False)).alias("has_table"),
        F.coalesce(F.bool_or("has_figure"), F.lit(False)).alias("has_figure"),
        common_sentiment("sentiment").alias("sentiment"),
        F.array_join(_ordered("summary"), " ").alias("summary"),
    ]


def _with_texts(records: DataFrame, rows: DataFrame, keys: list[str], quotes: int) -> DataFrame:
    """The records with their distinct texts of each kind, first spelling kept,
    in order: one flat table of all kinds, aggregated in parts."""
    kinds = [t for t in TEXTS if t in rows.columns]
    marked = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x.alias("text"))
    each = F.flatten(F.array(*[F.transform(F.coalesce(F.col(t), F.array().cast("array<string>")), marked(t)) for t in kinds]))
    flat = rows.select(*keys, "_at", F.explode(each).alias("_x")).where(F.col("_x.text").isNotNull())
    first = flat.groupBy(*keys, F.col("_x.kind").alias("kind"), gist("_x.text").alias("gist")).agg(F.min(F.struct("_at", F.col("_x.i").alias("i"), F.col("_x.text").alias("text"))).alias("v"))
    sides = first.groupBy(*keys).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == t, F.col("v")))), lambda x: x["text"]).alias(t) for t in kinds])
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    both = records.alias("r").join(sides.alias("t"), same, "left")
    none = F.array().cast("array<string>")
    shown = {t: F.coalesce(F.col(f"t.{t}"), none) for t in kinds}
    if "salient_quotes" in shown:
        shown["salient_quotes"] = F.slice(shown["salient_quotes"], 1, quotes)
    return both.select("r.*", *[c.alias(t) for t, c in shown.items()])
