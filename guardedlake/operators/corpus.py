"""Schema documents to stored chunks: split, enrich, embed, upsert, summarise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardedlake.functions.ordered import latest
from guardedlake.functions.text import is_blank, markdown_line, sample_cell, slug, strip, words

# The headings, tags and ids a schema document is read by.
ENUM_TITLE = "Known categorical values"
ENUM_ID = "enum:categorical-values"
OVERVIEW_ID = "overview"
OVERVIEW_TITLE = "Schema Overview"

_TAIL = r"<sql>(.*?)</sql>\s*</example>"
_HEAD = r"(?s)<example>\s*<question>(.*?)</question>\s*"
# Group 1 is the question, the last group the SQL; the looser form lets one other
# tagged block stand between the two.
_EXAMPLE = {True: (_HEAD + _TAIL, 2), False: (_HEAD + r"(?:<(\w+)>.*?</\2>\s*)??" + _TAIL, 3)}
_ENUM = rf"(?ms)^# (?i:{ENUM_TITLE})$(.*?)(?=^# |\z)"
_FIRST_ENUM = rf"(?ms)\A(.*?)^# (?i:{ENUM_TITLE})$.*?(?=^# |\z)"

_CHUNK = "struct<chunk_id:string,kind:string,title:string,content:string,embed_text:string>"
CHUNK_COLUMNS = ["chunk_id", "kind", "title", "content", "embed_text"]


def _chunk(chunk_id: Column, kind: str, title: Column, content: Column, embed: Column) -> Column:
    return F.struct(chunk_id.alias("chunk_id"), F.lit(kind).alias("kind"), title.alias("title"),
                    content.alias("content"), embed.alias("embed_text"))


def _example_chunk(block: Column, pattern: str, sql_group: int) -> Column:
    question = strip(F.regexp_extract(block, pattern, 1))
    sql = strip(F.regexp_extract(block, pattern, sql_group))
    content = F.concat(F.lit("Question: "), question, F.lit("\n\nSQL:\n```sql\n"), sql, F.lit("\n```"))
    return _chunk(F.concat(F.lit("example:"), slug(question)), "EXAMPLE", question, content, question)


def _table_chunk(piece: Column) -> Column:
    title = strip(F.regexp_extract(piece, r"\A## (.+)", 1))
    body = strip(piece)
    return _chunk(F.concat(F.lit("table:"), slug(title)), "TABLE", title, body, body)


def split_documents(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Cut ``(doc_id, text)`` into chunks, in the order examples, enum, overview, tables.

    Each document is handled in its own row by column expressions, so the step
    needs no shuffle. ``strict`` keeps the narrow reading, in which an example with
    a block between question and SQL is no example and a table section runs over
    later first-level headings; otherwise a section ends at such a heading, and the
    prose under it joins the overview, so that no text is lost.
    """
    pattern, sql_group = _EXAMPLE[strict]
    heading = r"(?m)(?=^## .)" if strict else r"(?m)(?=^##? .)"
    base = docs.where(~is_blank("text"))
    cut = (base
           .withColumn("__ex", F.regexp_extract_all("text", F.lit(pattern), 0))
           .withColumn("__enum", strip(F.regexp_extract("text", _ENUM, 1)))
           .withColumn("__rest", F.regexp_replace(F.regexp_replace("text", _FIRST_ENUM, "$1"), pattern, ""))
           .withColumn("__pieces", F.split("__rest", heading)))
    tables = F.filter("__pieces", lambda p: p.startswith("## "))
    # Leading text belongs to the overview as it is; a later first-level section
    # only if it holds more than its heading.
    others = F.filter("__pieces", lambda p, i: ~p.startswith("## ") & (
        p.rlike(r"\S") if strict else ((i == 0) & p.rlike(r"\S")) | p.rlike(r"(?s)\A# [^\n]*\n.*\S")))
    cut = (cut.withColumn("__over", strip(F.array_join(F.transform(others, strip), "\n\n")))
           .withColumn("__tables", tables))
    empty = F.array().cast(f"array<{_CHUNK}>")
    enum = F.when(F.col("__enum") != "", F.array(_chunk(
        F.lit(ENUM_ID), "ENUM", F.lit(ENUM_TITLE), F.col("__enum"), F.col("__enum")))).otherwise(empty)
    overview = F.when(F.col("__over") != "", F.array(_chunk(
        F.lit(OVERVIEW_ID), "OVERVIEW", F.lit(OVERVIEW_TITLE), F.col("__over"), F.col("__over")))).otherwise(empty)
    chunks = F.concat(
        F.transform("__ex", lambda b: _example_chunk(b, pattern, sql_group)), enum, overview,
        F.transform("__tables", _table_chunk))
    kept = [c for c in docs.columns if c != "text"]
    # The outer form keeps Spark from testing the array's size first, which would cut each document twice.
    return (cut.select(*kept, F.posexplode_outer(chunks).alias("pos", "c")).where("pos IS NOT NULL")
            .select(*kept, "pos", *[F.col(f"c.{c}").alias(c) for c in CHUNK_COLUMNS]))


def cleaned_title(title: Column | str) -> Column:
    """The table a title names, or null when it is no identifier."""
    name = strip(F.regexp_replace(title, "[`\"']", ""))
    return F.when(name.rlike(r"\A[a-zA-Z_][a-zA-Z0-9_.]*\z"), name)


def sample_markdown(name: str, table: DataFrame, key: list[str], rows: int = 3, cell_chars: int = 120) -> DataFrame:
    """``(table_name, sample)``: the first ``rows`` rows by ``key`` as a markdown table.

    Ordering and limit together are a top-k, so each task keeps ``rows`` rows only.
    An empty table gives no row.
    """
    picked = (table.orderBy(*key).limit(rows)
              .select(F.struct(*key).alias("k"),
                      F.rtrim(markdown_line([sample_cell(c, cell_chars) for c in table.columns])).alias("line")))
    header = "| " + " | ".join(table.columns) + " | \n|" + " --- |" * len(table.columns) + "\n"
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda e: e["line"]), " \n")
    return (picked.agg(F.count(F.lit(1)).alias("n"), lines.alias("lines")).where("n > 0")
            .select(F.lit(name).alias("table_name"), F.concat(F.lit(header), "lines").alias("sample")))


def enrich_tables(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Append sample rows to table chunks; every other chunk passes unchanged."""
    is_table = F.col("kind").eqNullSafe("TABLE")
    content = F.when(F.col("sample").isNotNull(),
                     F.concat("content", F.lit("\n\n### Sample rows\n\n"), "sample")).otherwise(F.col("content"))
    tables = (chunks.where(is_table).withColumn("__t", cleaned_title("title")).join(samples.withColumnRenamed("table_name", "__t"), "__t", "left")
              .withColumn("content", content).select(*chunks.columns))
    return tables.unionByName(chunks.where(~is_table))


Encoder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", batch: int = 256) -> DataFrame:
    """Add the vectors of a user's encoder; blank or null text gets a null vector.

    The encoder sees lists of at most ``batch`` texts, and is created once per
    Python worker if it is a factory that caches its own model.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            result = pd.Series([None] * len(texts), dtype=object)
            filled = np.flatnonzero(texts.notna().to_numpy())
            for start in range(0, len(filled), batch):
                rows = filled[start:start + batch]
                vectors = np.asarray(encoder(texts.iloc[rows].tolist()), dtype=np.float32)
                for row, vector in zip(rows, vectors):
                    result.iat[row] = vector
            yield result

    # Marked as not repeatable, so that no rewrite of the plan calls the encoder twice per row.
    return df.withColumn(out, encode.asNondeterministic()(F.when(~is_blank(text), F.col(text))))


def fast_bucket(word: Column, dim: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(dim)).cast("int")


def portable_bucket(word: Column, dim: int) -> Column:
    """A bucket any other engine computes alike; three times the cost of ``fast_bucket``."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


ROWS_AT_ONCE = 1_024  # texts whose counts are one matrix


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _unit_counts(buckets: pd.Series, dims: pd.Series) -> pd.Series:
    dim, out = int(dims.iloc[0]) if len(dims) else 1, []
    for at in range(0, len(buckets), ROWS_AT_ONCE):
        part = [np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in buckets.iloc[at:at + ROWS_AT_ONCE]]
        sizes = [len(x) for x in part]
        places = np.concatenate(part) + np.repeat(np.arange(len(part)) * dim, sizes)
        counts = np.bincount(places, minlength=len(part) * dim).reshape(len(part), dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        units = np.divide(counts, norm, out=counts, where=norm > 0).astype(np.float32)
        out += [u if n else None for u, n in zip(units, sizes)]
    return pd.Series(out, dtype=object)


def embed_by_hash(df: DataFrame, text: str, dim: int = 1536, out: str = "embedding",
                  bucket: Callable[[Column, int], Column] = fast_bucket) -> DataFrame:
    """The stand-in encoder: hashed word counts of the whole text, at unit length.

    Words are cut and hashed in the JVM; Arrow carries one array of bucket numbers
    per row to the counting step, so no row leaves its partition.
    """
    buckets = F.transform(words(text), lambda w: bucket(w, dim))
    return df.withColumn(out, _unit_counts.asNondeterministic()(buckets, F.lit(dim)))


def reset_namespace(stored: DataFrame, namespace: str) -> DataFrame:
    """Everything but one namespace; on a table partitioned by it, whole folders."""
    return stored.where(F.col("namespace") != namespace)


def upsert(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Replace stored chunks by incoming ones of the same ``(namespace, chunk_id)``.

    ``order`` ranks incoming rows, the later wins; ``created_at`` stays that of the
    first arrival. Both sides are reduced to one row per key by aggregates with a
    map-side part, so a chunk that arrives a billion times still sends one row per
    task.
    """
    keys = ["namespace", "chunk_id"]
    fields = [c for c in stored.columns if c not in (*keys, "created_at")]
    rank = F.struct(F.lit(1).alias("batch"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    none = F.struct(F.lit(0).alias("batch"), *[F.lit(None).cast(incoming.schema[c].dataType).alias(f"o{i}")
                                                for i, c in enumerate(order)])
    payload = F.struct(*fields).alias("__row")
    both = (stored.select(*keys, "created_at", none.alias("__rank"), payload)
            .unionByName(incoming.select(*keys, "created_at", rank.alias("__rank"), payload)))
    return (both.groupBy(*keys)
            .agg(F.max_by("__row", "__rank").alias("__row"), F.min("created_at").alias("created_at"))
            .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in fields], "created_at"))


def last_in_batch(chunks: DataFrame, order: list[str]) -> DataFrame:
    """One row per ``(namespace, chunk_id)``: two titles with one slug overwrite each other."""
    return latest(chunks, ["namespace", "chunk_id"], order)


def ingest_summary(chunks: DataFrame) -> DataFrame:
    """Chunks by namespace and kind, with the namespace total on each row."""
    per_kind = chunks.groupBy("namespace", "kind").agg(F.count(F.lit(1)).alias("n_chunks"))
    return per_kind.withColumn("n_total", F.sum("n_chunks").over(Window.partitionBy("namespace")))
