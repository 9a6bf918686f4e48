"""Named tables: scans, temporary views, and counts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAR_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Parquet tables of one folder, scanned lazily: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.scan(name)

    def spread(self, name: str) -> DataFrame:
        """A scan dealt over the cores, for costly work per row on a table of few files.

        A table with more splits than cores, as any large one has, is left as it is.
        """
        df, cores = self.scan(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def register(self, names: Iterable[str] = STAR_TABLES) -> None:
        """Make each table a temporary view, for SQL text."""
        for name in names:
            self.scan(name).createOrReplaceTempView(name)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
               partitions: int, **options: str) -> DataFrame:
    """A database table, read in parallel key ranges instead of by one task."""
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower,
                     upperBound=upper, numPartitions=partitions, **options)
            .load())


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)``, exact; plain parquet scans answer from footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def save_partitioned(df: DataFrame, path: str, *partition_by: str, sort: Iterable[Column | str] = ()) -> None:
    """Write with one writer task per partition value and file, sorted for min/max pruning.

    ``repartition`` on the partition columns would send a hot value to one task;
    adaptive ``rebalance`` splits such a value over several.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    if sort:
        out = out.sortWithinPartitions(*partition_by, *sort)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
