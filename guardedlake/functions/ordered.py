"""Order-dependent totals and texts that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                  span: int = 100_000) -> DataFrame:
    """Inclusive running sum of ``value`` by integer ``order`` within ``keys``.

    Two levels: each key is cut into ranges of ``span`` order values, the range
    totals are summed first, and the rows are then scanned range by range. A key
    that holds most of the rows is so spread over as many tasks as it has ranges.
    """
    seg = "__segment"
    rows = df.withColumn(seg, F.floor(F.col(order) / span)).withColumn("__v", value.cast("long"))
    before = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, seg).agg(F.sum("__v").alias("__t"))
               .select(*keys, seg, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o")))
    inside = Window.partitionBy(*keys, seg).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(offsets, [*keys, seg])
            .withColumn(out, F.col("__o") + F.sum("__v").over(inside))
            .drop(seg, "__v", "__o"))


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, out: str, sep: str = "",
                 span: int = 1_000) -> DataFrame:
    """Join the texts of each key in the order of the integer column ``order``.

    Runs of ``span`` order values are joined first, so no task ever gathers all
    rows of a key; only the joined text, which has to be one cell, is whole.
    """
    seg = F.floor(F.col(order) / span).alias("__segment")

    def joined(entries: str) -> Column:
        return F.array_join(F.transform(F.array_sort(entries), lambda e: e["t"]), sep)

    runs = (df.where(F.col(text).isNotNull())
            .groupBy(*keys, seg).agg(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))).alias("e"))
            .select(*keys, "__segment", joined("e").alias("t")))
    return (runs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("__segment").alias("o"), "t")).alias("e"))
            .select(*keys, joined("e").alias(out)))


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key that comes last in ``order`` (which must be total).

    ``row_number() = 1`` lets Spark cut every key to one row before the shuffle.
    """
    desc = [(F.col(c) if isinstance(c, str) else c).desc() for c in order]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*desc))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered; cut per map task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
