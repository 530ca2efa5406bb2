"""Points in ranges as an equi-join, however long the ranges are.

A range goes to the bins of its own scale: of width 2**k, the least that is not
shorter than the range, so it lies in one bin or two. A point is looked for once
on each scale that some range has (at most 64). Long and short ranges don't get
into each other's way, an absurdly long one is two rows like any other, and the
rows of a hot key are spread over its bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the scale of ranges that are open at an end: one bin from zero up, one below
OPEN = 63


def in_ranges(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, low: str, high: str) -> DataFrame:
    """Rows of ``points`` joined to the rows of ``ranges`` of equal ``on`` that
    hold ``at``, both ends included; a null end is open. Ranges that end before
    they begin, null points and null keys have no match."""
    start, end = F.col(low).cast("long"), F.col(high).cast("long")
    length = F.try_subtract(end, start)
    # the number of digits of the length less one, in base two
    scale = F.when(start.isNull() | end.isNull() | length.isNull() | (length >= 1 << 60), OPEN).when(length <= 0, 0).otherwise(F.length(F.bin(length))).cast("int")
    first, last = F.coalesce(start, F.lit(-(1 << 63)).cast("long")), F.coalesce(end, F.lit((1 << 63) - 1).cast("long"))
    kept = ranges.where(F.coalesce(start <= end, F.lit(True))).withColumn("_scale", scale)
    binned = kept.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(first), _bin(last)))))
    scales = [r[0] for r in kept.select("_scale").distinct().collect()]
    own = F.array(*[F.struct(F.lit(s).alias("_scale"), F.shiftright(F.col(at).cast("long"), s).alias("_bin")) for s in sorted(scales)])
    each = points.select("*", F.inline(own)) if scales else points.select("*", F.lit(0).alias("_scale"), F.lit(0).cast("long").alias("_bin"))
    inside = (F.col(at) >= F.coalesce(F.col(low), F.col(at))) & (F.col(at) <= F.coalesce(F.col(high), F.col(at)))
    return each.join(binned, [*on, "_scale", "_bin"]).where(inside).drop("_scale", "_bin")


def _bin(place: Column) -> Column:
    return F.call_function("shiftright", place, F.col("_scale"))
