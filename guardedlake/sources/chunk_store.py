"""A chunk table in hash buckets, of which an upsert rewrites only those that it touches.

A store is a folder of bucket folders and of numbered manifests that say which of them
are in force. A write puts the new state of the touched buckets into folders of its own
and then creates the next manifest; that file can be created once, so of two writers
that began from the same version one fails and readers never see half a write. Files of
older versions stay until ``vacuum``.

What is stored is not shuffled by an upsert: rows that stay go from the files of their
bucket into new files of it, and only keys, or with them creation times, are compared.
Spark sends the incoming keys to the stored rows if it has measured them to be few, and
sorts both otherwise.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardedlake.operators.corpus import last_in_batch, portable_bucket
from guardedlake.session import materialise

KEYS = ["namespace", "chunk_id"]


class ConcurrentWrite(RuntimeError):
    """Another writer has published the version this one was about to."""


class Manifest(NamedTuple):
    """A version: the folder of each bucket that holds rows, and the version that wrote it."""

    version: int
    buckets: int
    schema: str
    folders: dict[int, tuple[str, int]]


class _Files:
    """The few file operations that the driver needs, on whatever file system the path is."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.io = spark._jvm.org.apache.commons.io.IOUtils

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path_of(path))] if self.fs.exists(self.path_of(path)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path_of(path))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whether the file is there with ``text`` now and was not there before."""
        try:
            stream = self.fs.create(self.path_of(path), False)
        except Exception as failure:
            if "exist" in str(failure):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def remove(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)


class ChunkStore:
    """``read``, ``upsert``, ``reset``, ``compact`` and ``vacuum`` of the chunk table in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | T.StructType, buckets: int = 256) -> ChunkStore:
        """An empty store; ``buckets`` should grow with the table, so that a bucket is a few files."""
        store = cls(spark, path)
        text = schema if isinstance(schema, str) else json.dumps(schema.jsonValue())
        store._publish(Manifest(0, buckets, text, {}))
        return store

    def manifest(self) -> Manifest:
        """The newest complete manifest."""
        for name in sorted((n for n in self.files.names(f"{self.path}/manifests") if n.startswith("v")), reverse=True):
            text = self.files.read(f"{self.path}/manifests/{name}")
            if text.endswith("\n"):
                found = json.loads(text)
                return Manifest(found["version"], found["buckets"], found["schema"], {int(b): tuple(f) for b, f in found["folders"].items()})
        raise FileNotFoundError(f"no chunk store in {self.path}")

    def _publish(self, new: Manifest) -> None:
        if not self.files.create(f"{self.path}/manifests/v{new.version:010}.json", json.dumps(new._asdict()) + "\n"):
            raise ConcurrentWrite(f"version {new.version} of {self.path} has been published by another writer")

    def _schema(self, at: Manifest) -> T.StructType:
        return T.StructType.fromJson(json.loads(at.schema)) if at.schema.startswith("{") else T.StructType.fromDDL(at.schema)

    def bucket(self, at: Manifest | None = None) -> Column:
        return portable_bucket(F.concat_ws("/", *KEYS), (at or self.manifest()).buckets)

    def read(self, buckets: list[int] | None = None, at: Manifest | None = None) -> DataFrame:
        """The table, or some of its buckets, as of the newest version or ``at``."""
        at = at or self.manifest()
        paths = [f"{folder}/bucket={b}" for b, (folder, _) in sorted(at.folders.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self._schema(at)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(at))

    def versions(self, at: Manifest | None = None) -> DataFrame:
        """bucket, version: when each bucket that holds rows was written last."""
        at = at or self.manifest()
        return self.spark.createDataFrame([(b, v) for b, (_, v) in at.folders.items()], "bucket int, version int")

    def _rewrite(self, at: Manifest, touched: list[int], rows: DataFrame) -> int:
        """Write ``rows`` as all that the touched buckets hold and publish the next version."""
        version, folder = at.version + 1, f"{self.path}/data/v{at.version + 1:010}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket(at)).write.partitionBy("bucket").parquet(folder)
        written = {int(n.split("=")[1]) for n in self.files.names(folder) if n.startswith("bucket=")}
        folders = {b: f for b, f in at.folders.items() if b not in set(touched)} | {b: (folder, version) for b in written}
        self._publish(at._replace(version=version, folders=folders))
        return version

    def _touched(self, at: Manifest, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket(at).alias("b")).distinct().collect())  # at most as many as there are buckets

    def merged(self, at: Manifest, incoming: DataFrame) -> tuple[list[int], DataFrame]:
        """The buckets that ``incoming`` (a row per key) touches, and what they hold afterwards."""
        touched = self._touched(at, incoming)
        old, keys = self.read(touched, at), incoming.select(*KEYS)
        born = old.select(*KEYS, F.col("created_at").alias("_born")).join(keys, KEYS, "left_semi")
        new = incoming.join(born, KEYS, "left").withColumn("created_at", F.least("created_at", "_born")).select(*old.columns)
        return touched, old.join(keys, KEYS, "left_anti").select(*old.columns).unionByName(new.hint("rebalance", *KEYS))

    def upsert(self, incoming: DataFrame, order: list[str]) -> int:
        """Replace chunks of the same ``(namespace, chunk_id)`` and add the others; gives the new version.

        ``order`` ranks incoming rows, the later wins; ``created_at`` stays that of the
        first arrival.
        """
        at = self.manifest()
        columns = [f.name for f in self._schema(at)]
        first = incoming.groupBy(*KEYS).agg(F.min("created_at").alias("_first"))
        latest = last_in_batch(incoming, order).join(first, KEYS).withColumn("created_at", F.col("_first")).select(*columns)
        touched, rows = self.merged(at, materialise(latest, "incoming"))
        return self._rewrite(at, touched, rows) if touched else at.version

    def reset(self, namespace: str) -> int:
        """Empty a namespace; buckets that hold nothing of it stay as they are."""
        at = self.manifest()
        touched = self._touched(at, self.read(at=at).where(F.col("namespace") == namespace))
        return self._rewrite(at, touched, self.read(touched, at).where(F.col("namespace") != namespace)) if touched else at.version

    def compact(self) -> int:
        """Gather the files of each bucket; a bucket too large for a task stays in several."""
        at = self.manifest()
        rows = self.read(at=at)
        return self._rewrite(at, list(at.folders), rows.withColumn("_b", self.bucket(at)).hint("rebalance", "_b").drop("_b"))

    def vacuum(self) -> None:
        """Remove what the newest version doesn't need; no one may be reading an older one."""
        at = self.manifest()
        used = {folder.rsplit("/", 1)[1] for folder, _ in at.folders.values()}
        for name in self.files.names(f"{self.path}/data"):
            if name not in used:
                self.files.remove(f"{self.path}/data/{name}")
