"""Reads and writes of analysed records by key."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut

#: buckets of a record store, unless its first save says otherwise
BUCKETS = 64


def list_sections(sections: DataFrame, doc_id) -> DataFrame:
    """The section index of a document."""
    return sections.where(F.col("doc_id") == doc_id).select("section_name", "chapter_name", "pages", "summary")


def list_chapters(chapters: DataFrame, doc_id) -> DataFrame:
    """A10: whole chapter records."""
    return chapters.where(F.col("doc_id") == doc_id)


def list_chapter_summaries(chapters: DataFrame, doc_id) -> DataFrame:
    """A11."""
    return chapters.where(F.col("doc_id") == doc_id).select("chapter_name", "section_names", "pages", "summary")


def get_record(records: DataFrame, **keys) -> DataFrame:
    """The record of a key, at most one."""
    for name, value in keys.items():
        records = records.where(F.col(name) == value)
    return records.limit(1)


def segments_meta(segments: DataFrame, doc_id, section_name: str) -> DataFrame:
    """Segments of a section without their text, in numeric order."""
    return segments.where((F.col("doc_id") == doc_id) & (F.col("section_name") == section_name)).orderBy("seg_no").select("seg_id", "section_name", "chapter_name", "pages", "token_count")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records of ``new`` merged into ``old``; a field that the new record
    lacks (no column) keeps its old value, one that it has is set, null too."""
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.join(n, on, "full_outer")
    taken = F.col("n._new").isNotNull()
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}").alias(c))
        else:
            out.append(F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def missing_work(work: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose key is not stored yet."""
    return work.join(stored.select(*keys), list(keys), "left_anti")


def duplicates(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (there is no index to forbid it)."""
    return records.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unresolved(elements: DataFrame, entities: DataFrame, ref: str = "entity_ref") -> DataFrame:
    """Elements whose reference names no entity of their document."""
    named = entities.select("doc_id", F.lower("name").alias("_n")).distinct()
    asked = elements.where(F.col(ref).isNotNull()).withColumn("_n", F.lower(ref))
    return asked.join(named, ["doc_id", "_n"], "left_anti").drop("_n")


def catalogue_json(sections: DataFrame) -> DataFrame:
    """A document's sections as one compact JSON array for a planner."""
    one = F.struct("section_name", "chapter_name", "pages", "summary")
    return sections.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.array_min("pages"), F.lit(1_000_000_000)).alias("p"), "section_name", one.alias("s")))), lambda x: x["s"])).alias("catalogue"))


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and the JVM's path of a name below it."""
    jvm = spark.sparkContext._jvm
    at = lambda *below: jvm.org.apache.hadoop.fs.Path("/".join((path, *below)))
    return at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """The latest manifest: version, keys, number of buckets, columns, and the
    commit that wrote each bucket as it now is."""
    files, at = _files(spark, path)
    folder = at("manifest")
    if not files.exists(folder):
        return None
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    known = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not known:
        return None
    stream = files.open(at("manifest", f"{max(known):012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Make ``manifest`` the next version; false if another writer has made one
    of this number. The file is written aside and put in place in one step that
    fails where a file is there already."""
    files, at = _files(spark, path)
    aside, place = at("manifest", f".{uuid.uuid4().hex}"), at("manifest", f"{manifest['version']:012d}.json")
    stream = files.create(aside)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if files.getScheme() != "file":
        done = not files.exists(place) and files.rename(aside, place)
    else:  # a local rename would replace the file
        paths, name = spark.sparkContext._jvm.java.nio.file.Paths, lambda p: p.toUri().getPath()
        try:
            link = spark.sparkContext._jvm.java.nio.file.Files.createLink
            link(paths.get(name(place), _none(spark)), paths.get(name(aside), _none(spark)))
            done = True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            done = False
    files.delete(aside, False)
    return done


def _none(spark: SparkSession):
    return spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 0)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    """A record's bucket: the hash of its key's text, so that a key may be asked
    for in another type of the same spelling."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys]), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str, manifest: dict, chosen: Iterable[int] | None = None) -> DataFrame:
    """The records of some buckets (default: all), whose files alone are opened."""
    schema = T.StructType.fromJson(manifest["columns"])
    places = [f"{path}/data/{commit}/bucket={b}" for b, commit in manifest["commits"].items() if chosen is None or int(b) in chosen]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of the latest version, or none yet. What a reader has begun to
    read stays until ``vacuum``, whatever is saved meanwhile."""
    manifest = _manifest(spark, path)
    return None if manifest is None else _buckets(spark, path, manifest)


def read_key(spark: SparkSession, path: str, **key) -> DataFrame:
    """The record of a key, from the one bucket that can hold it;
    within it the files' statistics and Bloom filters rule row groups out."""
    manifest = _manifest(spark, path)
    if manifest is None or sorted(key) != sorted(manifest["keys"]):
        raise ValueError(f"no records with the key {sorted(key)} at {path}")
    schema = T.StructType([f for f in T.StructType.fromJson(manifest["columns"]) if f.name in key])
    asked = spark.createDataFrame([tuple(key[f.name] for f in schema)], schema)
    bucket = asked.select(_bucket(manifest["keys"], manifest["buckets"])).first()[0]
    found = _buckets(spark, path, manifest, [bucket])
    for name, value in key.items():
        found = found.where(F.col(name).eqNullSafe(F.lit(value)))
    return found.limit(1)


def save(new: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS, attempts: int = 20) -> int:
    """``new`` merged into the records at ``path``; the number of the
    version that shows it. Keys that repeat in ``new`` are an error.

    Records lie in buckets by the hash of their key (``buckets`` of them, fixed by
    the first save). Only buckets that ``new`` has a key of are read and written
    anew; a manifest names the commit of each bucket and is put in place in one
    step. If another writer's version came first, this one is made again on top
    of it, anew only where that writer changed the same buckets: nothing is lost,
    and readers see whole versions only. An empty ``new`` makes no version."""
    spark = new.sparkSession
    new = cut(new)
    twice = duplicates(new, keys).first()
    if twice is not None:
        raise ValueError(f"key occurs more than once: {twice.asDict()}")
    written: dict[str, tuple[str | None, str]] = {}  # bucket: the commit it is made on, and its own
    dealt = None
    for attempt in range(attempts):
        manifest = _manifest(spark, path)
        base = manifest or {"version": -1, "keys": list(keys), "buckets": buckets, "commits": {}, "columns": new.schema.jsonValue()}
        if base["keys"] != list(keys):
            raise ValueError(f"the records at {path} have the key {base['keys']}")
        placed = new.withColumn("bucket", _bucket(keys, base["buckets"]))
        if base["buckets"] != dealt:  # the first time, or another first save chose another number; at most as many rows as there are buckets
            dealt, written = base["buckets"], {str(r[0]): (None, "") for r in placed.select("bucket").distinct().collect()}
            if not written and manifest is not None:
                return base["version"]
        stale = [b for b, (on, own) in written.items() if not own or on != base["commits"].get(b)]
        columns = base["columns"]
        if stale:
            some = placed.where(F.col("bucket").isin([int(b) for b in stale])).drop("bucket")
            old = _buckets(spark, path, base, {int(b) for b in stale})
            rows = (upsert(old, some, keys) if manifest else some).withColumn("bucket", _bucket(keys, base["buckets"]))
            commit = uuid.uuid4().hex
            writer = rows.repartition("bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket")
            for key in keys:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            writer.parquet(f"{path}/data/{commit}")
            written |= {b: (base["commits"].get(b), commit) for b in stale}
        known = T.StructType.fromJson(columns)
        columns = T.StructType([*known, *(f for f in new.schema if f.name not in known.names)]).jsonValue()
        commits = base["commits"] | {b: own for b, (_, own) in written.items()}
        if _commit(spark, path, base | {"version": base["version"] + 1, "commits": commits, "columns": columns}):
            return base["version"] + 1
        time.sleep(min(1.0, 0.02 * 2**attempt))
    raise RuntimeError(f"{attempts} other versions came first at {path}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the commits that the latest version doesn't show; how many went.
    Readers of older versions, and writers that are under way, lose theirs."""
    manifest = _manifest(spark, path)
    if manifest is None:
        return 0
    files, at = _files(spark, path)
    shown, gone = set(manifest["commits"].values()), 0
    for status in files.listStatus(at("data")):
        if status.getPath().getName() not in shown:
            files.delete(status.getPath(), True)
            gone += 1
    return gone


def progress(work: DataFrame, stored: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How much work is done, missing and there in all, by group if asked."""
    marked = work.join(stored.select(*keys).distinct().withColumn("_done", F.lit(True)), list(keys), "left")
    return marked.groupBy(*by).agg(F.count_if(F.col("_done").isNotNull()).alias("done"), F.count_if(F.col("_done").isNull()).alias("missing"), F.count("*").alias("total"))


# fixed values: tables and columns of the chat store
CHAT = {
    "users": "id string, identifier string, metadata string, createdAt string",
    "threads": "id string, createdAt string, name string, userId string, userIdentifier string, tags string, metadata string",
    "steps": "id string, name string, type string, threadId string, parentId string, input string, output string, isError boolean, metadata string, createdAt string, startTime string, endTime string",
    "feedbacks": "id string, forId string, threadId string, value int, comment string",
    "elements": "id string, threadId string, type string, url string, name string, forId string, mime string",
}


def create_tables(spark: SparkSession, database: str = "default", tables: dict[str, str] = CHAT) -> list[str]:
    """The chat store's tables, made where they are not there yet;
    columns that an older table lacks are added."""
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
        there = {c.lower() for c in spark.table(f"{database}.{name}").columns}
        lacking = [c for c in columns.split(", ") if c.split()[0].lower() not in there]
        if lacking:
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(lacking)})")
    return list(tables)
