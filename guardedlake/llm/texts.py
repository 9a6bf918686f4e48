"""Column helpers for operators that stay inside Spark's own expressions.

Lengths and offsets count code points. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the contract: what separates words.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SPAN = "array<struct<start:bigint,end:bigint>>"
CHUNK = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def carried(docs: DataFrame) -> Column:
    """All columns of a row as one, so that none of their names can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def unpacked(docs: DataFrame, new: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` out of a carried row, some of them replaced."""
    return [new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _prefixes(numbers: Column, first: Column) -> Column:
    return F.slice(F.aggregate(numbers, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 1, F.size(numbers))


def running_starts(numbers: Column) -> Column:
    """For each number the sum of those before it, in chunks so that long lists stay cheap."""
    def by_chunk(ns: Column) -> Column:
        last = F.floor((F.size(ns) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(ns, b * CHUNK + 1, F.lit(CHUNK)))
        return let(chunks, lambda cs: F.flatten(F.zip_with(cs, _prefixes(F.transform(cs, total), F.lit(0).cast("bigint")), _prefixes)))

    return F.when(F.size(numbers) > 0, let(numbers, by_chunk)).otherwise(F.array().cast("array<bigint>"))


class Cut(NamedTuple):
    """A text cut by a pattern: the pieces around its matches, the matches, and where those start."""

    pieces: Column
    matches: Column
    starts: Column


def cut(text: Column, pattern: str, body: Callable[[Cut], Column], empty: Column) -> Column:
    """``body`` of the leftmost non-overlapping matches of ``pattern``, or ``empty`` without any.

    The pattern is run twice, once for what matches and once for what lies between;
    offsets are the running lengths of both.
    """
    def found(pieces: Column, matches: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(matches) - 1)
        gaps = F.transform(places, lambda i: F.length(F.get(pieces, i)).cast("bigint"))
        steps = F.transform(places, lambda i: (F.length(F.get(pieces, i)) + F.length(F.get(matches, i))).cast("bigint"))
        return let(F.zip_with(running_starts(steps), gaps, lambda s, g: s + g), lambda starts: body(Cut(pieces, matches, starts)))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda ms: F.when(F.size(ms) > 0, let(F.split(text, pattern, -1), lambda ps: found(ps, ms))).otherwise(empty))


def spans(text: Column, pattern: str, good: Callable[[Column], Column] | None = None) -> Column:
    """Start and end of each match of ``pattern`` that ``good`` accepts; a refused match is not tried again."""
    def body(c: Cut) -> Column:
        rows = F.zip_with(c.starts, c.matches, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
        if good is not None:
            rows = F.filter(rows, lambda r: good(r["match"]))
        return F.transform(rows, lambda r: F.struct(r["start"].cast("bigint").alias("start"), r["end"].cast("bigint").alias("end")))

    return cut(text, pattern, body, F.array().cast(SPAN))


def joined(rows: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of rows that hold the kind's place, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(rows, lambda r: F.concat(F.get(names, r["kind"]), F.lit(":"), r["start"].cast("string"), F.lit(":"), r["end"].cast("string"))), ",")
