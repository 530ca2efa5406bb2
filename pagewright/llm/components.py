"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HOT, cut, joined_by_size


def components(edges: DataFrame, a: str = "a", b: str = "b", hot: int = HOT) -> DataFrame:
    """(node, root): for every node of an edge the least node it reaches.

    Each round joins every node to the least neighbour twice: first the larger
    neighbours of a node (large star), then the smaller ones (small star), till
    each node is tied to its root alone; edges that are such stars from the start
    need no round.  Rounds grow with the logarithm of the
    longest path, and each is written to the shared checkpoint folder; a node of
    over ``hot`` neighbours doesn't bring them to one task.  Edges
    may repeat, run in either direction or tie a node to itself; edges with a
    null end are ignored.  No edge gives no row."""
    found = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    found = cut(found.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    loops = found.where("u = v").select("u")
    now = found.where("u > v")
    while True:
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        # a node with a lesser neighbour and one more isn't tied to its root alone
        loose, most = least.agg(F.count(F.expr("if(m < u and n > 1, 1, null)")), F.max("n")).first()
        if not loose:
            break
        # large star: neighbours above u go to u's least; repeats go at the end of the round
        large = _met(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, most, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its lower neighbours, no more than it had, go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _met(large, low, most, hot)
        now = cut(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    tied = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = tied.select(F.col("root").alias("node"), "root").union(loops.select(F.col("u").alias("node"), F.col("u").alias("root")))
    return tied.union(roots).groupBy("node").agg(F.min("root").alias("root"))


def _met(rows: DataFrame, counted: DataFrame, most: int, hot: int) -> DataFrame:
    """``rows`` joined to ``counted`` by u; keys are set apart only if one is over ``hot``."""
    return joined_by_size(rows, counted, ["u"], hot=hot) if most > hot else rows.join(counted, "u")
