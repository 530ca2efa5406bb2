"""Sources and sinks: markdown, tables of contents, segments, traces, test corpus."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..retry import retried

LINES_PER_PAGE = 12


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paginated(documents: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """Plain documents as marked-up markdown (doc_id, text): a marker before each
    page, and from page 1 on a footer, left on odd and right on even pages. A
    document of null text has no page and is left out."""
    rows = F.split("text", "\n", -1)

    def page(p: Column) -> Column:
        body = F.array_join(F.slice(F.col("_l"), p * per_page + 1, F.lit(per_page)), "\n")
        number = p.cast("string")
        footer = F.when(p == 0, "").when(p % 2 == 1, F.concat(F.lit("\n"), number, F.lit(" | Report"))).otherwise(F.concat(F.lit("\nReport | "), number))
        return F.concat(F.lit("{"), number, F.lit("}------------------------------------------------\n"), body, footer)

    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / per_page).cast("int")), page)
    return documents.where("text is not null").select("doc_id", rows.alias("_l")).select("doc_id", F.array_join(pages, "\n").alias("text"))


def _stem() -> Column:
    """Stem of the file a row is from; file names come URL-encoded."""
    return X.file_stem(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file stem), text, page_count of markdown files.

    A path that does not exist raises at once."""
    from ..operators.pages import page_count

    whole = spark.read.text(path, wholetext=True).select(_stem().alias("doc_id"), F.col("value").alias("text"))
    return whole.withColumn("page_count", page_count("text"))


def write_markdown(docs: DataFrame, path: str) -> None:
    """One row for each document, kept by doc_id (A4, A5)."""
    docs.select("doc_id", "text").write.mode("overwrite").parquet(path)


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """Entries of table-of-contents files ``<stem>.toc.json``, a JSON array each
    (A6). What ``write_toc`` wrote holds its doc_id and is read as plain JSON."""
    entries = spark.read.schema("section_name string, chapter_name string, page_number string").json(path, multiLine=True)
    named = entries.withColumn("doc_id", F.regexp_replace(_stem(), r"\.toc$", ""))
    return named.select("doc_id", "section_name", "chapter_name", F.expr("try_cast(page_number as int)").alias("page_number"))


def write_toc(toc: DataFrame, path: str) -> None:
    toc.write.mode("overwrite").json(path)


SEGMENT = "struct<seg_id: string, section_name: string, chapter_name: string, pages: array<int>, token_count: int, text: string>"


def read_segments(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """Segments of segmentation files {doc_id, segments}, one object a file or, as
    ``write_segments`` leaves them, one object a line (A7)."""
    files = spark.read.schema(f"doc_id string, segments array<{SEGMENT}>").json(path, multiLine=not one_a_line)
    return files.select("doc_id", F.inline("segments"))


def write_segments(segments: DataFrame, path: str) -> None:
    """One JSON object for each document, segments in order."""
    one = F.struct("seg_id", "section_name", "chapter_name", "pages", "token_count", "text")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("seg_no"), one.alias("s")))), lambda x: x["s"])
    segments.groupBy("doc_id").agg(listed.alias("segments")).write.mode("overwrite").json(path)


def cached_or_new(cached: DataFrame, wanted: DataFrame, make) -> DataFrame:
    """Rows of ``cached`` and, for documents it lacks, what ``make`` gives (A5, K5)."""
    return cached.unionByName(make(wanted.join(cached, "doc_id", "left_anti")))


def converted(spark: SparkSession, path: str, converter) -> DataFrame:
    """Binary files turned to markdown by a user's function bytes -> text (A2);
    errors of a service it calls are retried, others fail the job (K6)."""

    def run(frames):
        call = retried(converter)
        for frame in frames:
            frame["text"] = [call(bytes(b)) for b in frame["content"]]
            yield frame[["doc_id", "text"]]

    files = spark.read.format("binaryFile").load(path).select(X.file_stem("path").alias("doc_id"), "content")
    return files.mapInPandas(run, "doc_id string, text string")


def read_traces(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """Run traces, one JSON object a file or, as ``write_traces`` leaves them, one
    object a line (M17)."""
    return spark.read.json(path, multiLine=not one_a_line)


def write_traces(traces: DataFrame, path: str) -> bool:
    """Add traces as JSON; a failure is logged and told, never raised."""
    try:
        traces.write.mode("append").json(path)
    except Exception:
        logging.getLogger(__name__).exception("traces were not written to %s", path)
        return False
    return True


def events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runtime events as they arrive in a folder of JSON lines."""
    return spark.readStream.schema(schema).json(path)
