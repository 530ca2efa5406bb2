"""Cleaning of image noise within a document's row (H7); nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# fixed values: what an image line and a heading look like
IMAGE = r"(?i)^!\[(.+?)\]\([^)]+\.(?:jpg|jpeg|png|svg|webp|gif)\)\s*$"
HEADING = r"^#{1,6}\s"
AHEAD = 200


def clean_images(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_next, n_later, n_figure, shrink_percent.

    An image line whose alt text is the next non-blank line goes (n_next); one
    whose alt text comes later in its block goes with that later line (n_later);
    any other becomes ``Figure: <alt>`` (n_figure). A block ends at a heading, an
    image line or after 200 lines; page markers don't end it. Runs of blank lines
    shrink to one (C6, E8, E9, F10, G3, H6, D25, H23)."""
    rows = docs.select("doc_id", "text", X.lines("text").alias("_l"))
    # without an image mark there is nothing to look for
    rows = rows.withColumn("_s", F.when(F.contains("text", F.lit("![")), F.transform("_l", X.strip)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_edge", F.transform("_s", lambda t: t.rlike(HEADING) | t.rlike(IMAGE)))
    place = F.filter(F.transform("_s", lambda t, i: F.when(t.rlike(IMAGE), F.struct(i.alias("i"), X.strip(F.regexp_extract(t, IMAGE, 1)).alias("alt")))), lambda x: x.isNotNull())
    rows = rows.withColumn("_img", place)

    def judged(x):
        stop = F.array_position(F.slice(F.col("_edge"), x["i"] + 2, F.lit(AHEAD)), True).cast("int")
        block = F.slice(F.col("_s"), x["i"] + 2, F.when(stop > 0, stop - 1).otherwise(F.lit(AHEAD)))
        again = F.when(x["alt"] == "", F.lit(0)).otherwise(F.array_position(block, x["alt"]).cast("int"))
        near = F.array_position(F.transform(block, lambda t: t != ""), True).cast("int")
        return F.struct(x["i"].alias("i"), x["alt"].alias("alt"), again.alias("again"), near.alias("near"))

    rows = rows.withColumn("_img", F.transform("_img", judged))
    gone = F.flatten(F.transform("_img", lambda x: F.when(x["again"] == 0, F.array().cast("array<int>")).when(x["again"] == x["near"], F.array(x["i"])).otherwise(F.array(x["i"], x["i"] + x["again"]))))
    figures = F.map_from_entries(F.transform(F.filter("_img", lambda x: x["again"] == 0), lambda x: F.struct(x["i"], F.concat(F.lit("Figure: "), x["alt"]))))
    rows = rows.withColumn("_gone", gone).withColumn("_fig", figures)
    kept = F.filter(F.transform("_l", lambda t, i: F.when(~F.array_contains(F.col("_gone"), i), F.coalesce(F.try_element_at("_fig", i), t))), lambda t: t.isNotNull())
    clean = F.when(F.size("_img") == 0, F.array_join("_l", "\n")).otherwise(F.array_join(kept, "\n"))
    rows = rows.withColumn("_c", X.collapse_blank(clean))
    count = lambda test: F.size(F.filter("_img", test))
    shrink = F.when(F.length("text") > 0, F.round(100.0 * (F.length("text") - F.length("_c")) / F.length("text"), 1)).otherwise(0.0)
    return rows.select(
        "doc_id",
        F.col("_c").alias("text"),
        count(lambda x: (x["again"] > 0) & (x["again"] == x["near"])).alias("n_next"),
        count(lambda x: (x["again"] > 0) & (x["again"] != x["near"])).alias("n_later"),
        count(lambda x: x["again"] == 0).alias("n_figure"),
        shrink.alias("shrink_percent"),
    )
