"""Catalog as data: columns, type profile, and a markdown reference of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN_SCHEMA = "table_name string, pos int, column_name string, data_type string, nullable boolean, column_default string"


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column, tables by name and columns in their own order.

    The rows come from schemas the driver already holds, so the size is that of
    the catalog and not of the data. A default travels in the field metadata.
    """
    rows = [(name, pos, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("CURRENT_DEFAULT"))
            for name, df in sorted(tables.items())
            for pos, f in enumerate(df.schema.fields, start=1)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def database_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The same rows for the tables a metastore database lists."""
    found = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    return catalog_columns(spark, {t.name: spark.table(f"{database}.{t.name}" if database else t.name) for t in found})


def type_bucket(data_type: str | F.Column) -> F.Column:
    """``text``, ``numeric`` or ``date`` by the declared type, else ``other``."""
    col = F.col(data_type) if isinstance(data_type, str) else data_type
    return (F.when(col.rlike("^(string|varchar|char)"), "text")
            .when(col.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"), "numeric")
            .when(col.rlike("^(date|timestamp)"), "date")
            .otherwise("other"))


def type_profile(columns: DataFrame) -> DataFrame:
    """Number of columns of each bucket per table."""
    kinds = ["text", "numeric", "date", "other"]
    return (columns.withColumn("bucket", type_bucket("data_type"))
            .groupBy("table_name").pivot("bucket", kinds).agg(F.count(F.lit(1)))
            .select("table_name", *[F.coalesce(F.col(k), F.lit(0)).alias(f"n_{k}") for k in kinds]))


def table_markdown(columns: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``(table_name, markdown)``: heading, row count if known, column table."""
    line = F.concat(F.lit("| "), "column_name", F.lit(" | "), "data_type", F.lit(" | "),
                    F.when(F.col("nullable"), "YES").otherwise("NO"), F.lit(" | "),
                    F.coalesce("column_default", F.lit("")), F.lit(" |\n"))
    body = columns.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    if counts is None:
        counts = body.select("table_name", F.lit(-1).alias("row_count"))
    count_line = F.when(F.col("row_count") >= 0,
                        F.concat(F.lit("Estimated row count: ~"), F.col("row_count").cast("string"), F.lit("\n\n")))
    return (body.join(counts, "table_name", "left")
            .select("table_name", F.concat(
                F.lit("## "), "table_name", F.lit("\n\n"), F.coalesce(count_line, F.lit("")),
                F.lit("| Column | Type | Nullable | Default |\n| --- | --- | --- | --- |\n"),
                F.array_join(F.col("lines.line"), ""), F.lit("\n")).alias("markdown")))


def catalog_markdown(per_table: DataFrame, title: str = "Database Schema Reference",
                     note: str = "Auto-generated from the catalog.") -> DataFrame:
    """The one-document form, tables by name; its size is bounded by the catalog."""
    return (per_table.agg(F.array_sort(F.collect_list(F.struct("table_name", "markdown"))).alias("parts"))
            .select(F.lit("catalog").alias("doc_id"),
                    F.concat(F.lit(f"# {title}\n\n{note}\n\n"), F.array_join("parts.markdown", "")).alias("text")))
