"""The corpus job: documents to a stored, searchable chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.operators.corpus import embed, embed_by_hash, enrich_tables, last_in_batch, reset_namespace, split_documents, upsert
from guardedlake.session import fresh_path
from guardedlake.sources.chunk_store import ChunkStore
from guardedlake.sources.tables import save_partitioned

STORED_SCHEMA = ("namespace string, chunk_id string, kind string, title string, content string, embed_text string, "
                 "embedding array<float>, created_at timestamp")


def prepared_chunks(docs: DataFrame, namespace: str | Column, created_at: Column, samples: DataFrame | None = None,
                    encoder=None, dim: int = 1536, strict: bool = False) -> DataFrame:
    """Chunks of documents with vectors, ready to be stored.

    A chunk id that comes twice in a namespace keeps the later one, so the expensive
    encoder runs after that choice.
    """
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    chunks = split_documents(docs, strict)
    if samples is not None:
        chunks = enrich_tables(chunks, samples)
    chunks = last_in_batch(chunks.withColumn("namespace", ns), ["doc_id", "pos"])
    chunks = embed_by_hash(chunks, "embed_text", dim) if encoder is None else embed(chunks, "embed_text", encoder)
    return chunks.withColumn("created_at", created_at)


def ingest(docs: DataFrame, stored: DataFrame, namespace: str | Column, created_at: Column, reset: str | None = None,
           samples: DataFrame | None = None, encoder=None, dim: int = 1536, strict: bool = False) -> DataFrame:
    """The chunk table after the documents are in; nothing is written.

    ``reset`` names a namespace that is emptied first; without it, chunks that the
    documents no longer hold stay.
    """
    if reset is not None:
        stored = reset_namespace(stored, reset)
    incoming = prepared_chunks(docs, namespace, created_at, samples, encoder, dim, strict)
    return upsert(stored, incoming, ["doc_id", "pos"])


def ingest_into(store: ChunkStore, docs: DataFrame, namespace: str | Column, created_at: Column, reset: str | None = None,
                samples: DataFrame | None = None, encoder=None, dim: int = 1536, strict: bool = False) -> int:
    """Bring documents into a bucketed chunk store; only buckets of their chunks are rewritten. Gives the new version."""
    if reset is not None:
        store.reset(reset)
    return store.upsert(prepared_chunks(docs, namespace, created_at, samples, encoder, dim, strict), ["doc_id", "pos"])


def store(chunks: DataFrame, name: str = "chunks") -> str:
    """Write a chunk table by namespace to a new folder and give its path.

    The folder that is being read is never the one written; a reader switches to the
    new path when the job is done.
    """
    path = fresh_path(chunks.sparkSession, name)
    save_partitioned(chunks, path, "namespace", sort=["kind", "chunk_id"])
    return path
