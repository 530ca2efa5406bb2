"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation many times: a snapshot after each turn, the
later ones beginning with all turns of the earlier ones.  The turns of each
conversation are put in order and hashed cumulatively: the hash of turn i
covers turns 1 to i.  A conversation whose last hash is among the inner hashes
of another one is a prefix of it and goes (anti-join); of conversations with
the same turns the one with the least conv_id stays.  What is left is maximal
and is rendered.

Hashes are SHA-256, so equal hashes are taken as equal turns.  Only hashes and
ids meet in the anti-join: copies are counted in two steps, so that a log of
which a third are equal is dealt over many tasks, inner hashes are made distinct
by partial aggregation, and the turns of what is left are fetched by conv_id.

Defined cases: a null role or text is empty; turns are ordered by (turn, role,
text), null turns first; repeated rows are repeated turns; a row of null
conv_id belongs to no other row and is a conversation of one turn; a copy with
an id names the group before one without; long conversations are hashed in
time that follows their length; a conversation is one cell of the result and
has to fit in it (2 GB); an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import table

#: turns that are hashed at a time; parts that copies are counted in first
PART, SALTS = 128, 32
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turns (ordered array of role and text) of the rows with a conv_id."""
    rows = _clean(turns).where(F.col("conv_id").isNotNull())
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _single(turns: DataFrame) -> DataFrame:
    """The distinct rows without a conv_id, as conversations of one turn, with their number."""
    rows = _clean(turns).where(F.col("conv_id").isNull()).groupBy("conv_id", "role", "text").agg(F.count("*").alias("n"))
    return rows.select("conv_id", F.array(F.struct("role", "text")).alias("turns"), "n")


def hashes(turns: str = "turns") -> Column:
    """The rolling hashes of an array column of turns, one each. They are made in parts
    of ``PART`` turns, each part going on from the last hash of the one before."""
    # lengths make the joined string unambiguous
    step = "sha2(concat(element_at(h, -1), ':', length(t.role), ':', t.role, length(t.text), ':', t.text), 256)"
    parts = f"transform(sequence(0, greatest(size(v) - 1, 0) div {PART}), c -> slice(v, int(c * {PART} + 1), {PART}))"
    part = f"aggregate(p, array(acc.last), (h, t) -> concat(h, array({step})))"
    grown = f"transform(array({part}), x -> struct(element_at(x, -1) as last, concat(acc.done, array(slice(x, 2, size(p)))) as done))[0]"
    whole = f"aggregate({parts}, struct('' as last, cast(array() as array<array<string>>) as done), (acc, p) -> {grown}, acc -> flatten(acc.done))"
    return F.expr(f"transform(array({turns}), v -> {whole})[0]")


def snapshots(turns: DataFrame) -> DataFrame:
    """conv_id, turns, n (rows without an id that are equal) and hashes (rolling, one per turn)."""
    logged = _ordered(turns).withColumn("n", F.lit(1).cast("long")).unionByName(_single(turns))
    return logged.withColumn("hashes", hashes())


def maximal(turns: DataFrame) -> DataFrame:
    """The conversations that are no prefix of another one: conv_id, turns,
    n_copies (conversations with exactly these turns)."""
    logged = snapshots(turns)
    ends = logged.select("conv_id", "n", F.element_at("hashes", -1).alias("last"), F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt"))
    for keys in (["last", "salt"], ["last"]):
        ends = ends.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    inner = logged.select(F.explode(F.expr("slice(hashes, 1, size(hashes) - 1)")).alias("last")).distinct()
    kept = ends.join(inner, "last", "left_anti").withColumnRenamed("n", "n_copies")
    named = kept.where(F.col("conv_id").isNotNull()).join(_ordered(turns), "conv_id")
    alone = _single(turns).select("turns", F.element_at(hashes(), -1).alias("last"))
    unnamed = kept.where(F.col("conv_id").isNull()).join(alone, "last")
    return named.select("conv_id", "turns", "n_copies").unionByName(unnamed.select("conv_id", "turns", "n_copies"))


def render(conversations: DataFrame) -> DataFrame:
    """``turns`` in the marked-up form that chat models are trained on."""
    said = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)))
    return conversations.withColumn("rendered", F.array_join(said, ""))


def op7_chat(spark, sf_dir: str) -> DataFrame:
    found = render(maximal(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", "rendered")


OP7_SQL = """
WITH r AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
t AS (
  SELECT conv_id, alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM r),
p AS (
  SELECT conv_id, alone, i,
         sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY i)
           OVER (PARTITION BY conv_id, alone ORDER BY i ROWS UNBOUNDED PRECEDING)) AS prefix,
         count(*) OVER (PARTITION BY conv_id, alone) AS n,
         role, text
  FROM t),
c AS (
  SELECT conv_id, max(n) AS n_turns, max(CASE WHEN i = n THEN prefix END) AS whole,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
  FROM p GROUP BY conv_id, alone)
SELECT min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies, min(rendered) AS rendered
FROM c
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = c.whole AND p.i < p.n)
GROUP BY whole
"""
