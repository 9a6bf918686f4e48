"""Which rows may have a match elsewhere, told where they lie.

A join moves all rows of both sides, long texts too, once neither side is small enough to
be sent. Where few rows can match, the keys of the other side become a bit table, whose
size follows their number up to a fixed bound; it is written once and reaches the tasks
as the value of a scalar subquery. Rows that it holds are joined, the others stay where
they are. It lets some through by chance, which the join sorts out, but never holds a row
back that has a match. No step runs Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.session import materialise

# Bits for each key, the least and the most of a table (8 MB) as powers of two, and those of one of Spark's bitmaps.
BITS_EACH = 32
LEAST_BITS, MOST_BITS, BITMAP = 16, 26, 15


def _table(keys: DataFrame, hashed: Column, size: int) -> DataFrame:
    """One row with the bits of all keys in one binary value; a bit's byte and place follow from its number alone."""
    slot = hashed.bitwiseAND(size - 1)
    ones = keys.select(slot.alias("slot")).select(F.shiftright("slot", BITMAP).alias("part"), F.col("slot").bitwiseAND((1 << BITMAP) - 1).alias("place"))
    every = keys.sparkSession.range(size >> BITMAP).select(F.col("id").alias("part"), F.lit(None).cast("bigint").alias("place"))
    # Dealt by part first, as places are smaller than bitmaps that hold few of them.
    parts = ones.union(every).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    return parts.agg(F.expr("listagg(bits) WITHIN GROUP (ORDER BY part)").alias("bits"))


def may_match(keys: DataFrame, names: list[str]) -> Callable[..., Column]:
    """A test of columns, of the types of ``names`` and in their order: false only for rows that no row of ``keys`` equals, nulls being equal."""
    size = 1 << min(max((keys.count() * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    bits = materialise(_table(keys, F.xxhash64(*names), size), "sieve").scalar()

    def seen(*columns: Column | str) -> Column:
        slot = F.xxhash64(*columns).bitwiseAND(size - 1)
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, slot.bitwiseAND(7).cast("int")) == 1

    return seen
