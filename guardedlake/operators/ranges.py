"""Joins of points with the ranges that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDEST = 63  # at this level the bins are the negative and the other numbers


def _level(low: Column, high: Column) -> Column:
    """The least level whose bins, of ``2 ** level`` numbers, hold the range in two."""
    span = F.try_subtract(high, low)
    return F.when(span.isNull(), _WIDEST).when(span == 0, 0).otherwise(F.length(F.bin(span)))


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, how: str = "inner") -> DataFrame:
    """Each point beside every range with ``low <= value <= high``; ``how`` is inner or left.

    A join of equalities: a range is put into the one or two bins that cover it at the
    level of its own length, and a value is looked up in one bin of each level that any
    range has (64 at most), so long ranges cost no more rows than short ones and don't
    widen the bins of the others. Distinct values meet the ranges, not points; a value
    that a third of the points have is looked up once, and the points are then joined
    by value, which adaptive execution splits where it is skewed.

    Null bounds are open ends. A null value lies in no range, nor does any value in one
    whose low end is above its high one. Repeated points and ranges count each. Bounds and values may be
    of any numeric type; bins go by their whole part, in the range of a long. All columns
    of both sides are returned; ``ranges`` must not share names with ``points``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how has to be inner or left, not {how}")
    shared = set(points.columns) & set(ranges.columns)
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    whole = lambda c: F.floor(c).cast("bigint")
    a = F.coalesce(whole(F.col(low)), F.lit(-(2 ** 63)).cast("bigint"))
    z = F.coalesce(whole(F.col(high)), F.lit(2 ** 63 - 1).cast("bigint"))
    kept = ranges.where(F.col(low).isNull() | F.col(high).isNull() | (F.col(low) <= F.col(high)))
    sized = kept.withColumns({"__a": a, "__z": z}).withColumn("__level", _level(F.col("__a"), F.col("__z")))
    first, last = F.expr("shiftright(__a, __level)"), F.expr("shiftright(__z, __level)")
    binned = sized.withColumn("__bin", F.explode(F.array_distinct(F.array(first, last))))
    levels = sized.agg(F.collect_set("__level").alias("__levels"))
    values = points.where(F.col(value).isNotNull()).select(F.col(value).alias("__v")).distinct()
    looked = values.withColumn("__level", F.explode(levels.scalar())).withColumn("__bin", F.expr("shiftright(CAST(floor(__v) AS BIGINT), __level)"))
    inside = (F.col(low).isNull() | (F.col("__v") >= F.col(low))) & (F.col(high).isNull() | (F.col("__v") <= F.col(high)))
    met = looked.join(binned, ["__level", "__bin"]).where(inside).select("__v", *ranges.columns)
    return points.join(met, F.col(value) == F.col("__v"), how).drop("__v")
