"""Whole documents, from files or from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(doc_id, text)``, one row per file; a path that does not exist raises."""
    return (spark.read.text(path, wholetext=True)
            .select(F.input_file_name().alias("doc_id"), F.col("value").alias("text")))


def table_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` from any table that carries an id and a text column."""
    return df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))


# Endings of the codecs that the text reader unpacks.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
_BOM = 3  # bytes of a byte order mark, which the reader skips


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, line_no, line)`` for event logs, numbered from 0 within each file.

    A file is read in as many splits as Spark cuts it into, and no cell holds more than
    a line. One pass counts the lines of each split; running sums of those counts, one
    row a split, say where a split's numbers begin; the other pass adds a line's place
    in its split. Both read the same splits, since these depend on the listed files alone.

    Lines end at ``\\n``, with or without ``\\r`` before it. As in a split of the whole
    text, there is an empty line behind a last ``\\n``; a packed file, whose unpacked
    size isn't known, is taken to end in one. Empty files give no line.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    counted = lines.groupBy("file", "start").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = counted.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = lines.join(places, ["file", "start"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))
    ends = counted.groupBy("file").agg(F.sum("n").alias("line_no"), (F.max("size") - F.sum("bytes")).alias("rest"))
    closed = F.col("rest").isin(0, _BOM) | F.col("file").rlike(_PACKED)
    return numbered.unionByName(ends.where(closed).select("file", "line_no", F.lit("").alias("line")))
