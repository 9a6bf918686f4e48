"""Sources, catalog and corpus steps on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardedlake.functions.text import slug
from guardedlake.operators import corpus
from guardedlake.plans.ingest import STORED_SCHEMA, ingest, ingest_into
from guardedlake.plans.registry import named
from guardedlake.sources import catalog
from guardedlake.sources.chunk_store import ChunkStore
from guardedlake.sources.documents import table_documents
from guardedlake.session import fresh_path, materialise
from guardedlake.sources.tables import STAR_TABLES, Tables, row_counts

_LIST = ", ".join(f"'{t}'" for t in STAR_TABLES)
_COLUMNS_SQL = f"""
WITH columns_of AS (
  SELECT table_name, CAST(ordinal_position AS INTEGER) AS pos, column_name,
    CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
      WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS data_type
  FROM information_schema.columns WHERE table_name IN ({_LIST}))
"""
_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in STAR_TABLES)


def _all(spark, folder):
    t = Tables(spark, folder)
    return {name: t.scan(name) for name in STAR_TABLES}


@named("a01_table_scan", """
SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def a01(spark, folder):
    Tables(spark, folder).register(["orders", "customer"])
    return spark.sql("""SELECT c_mktsegment AS segment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
                        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")


@named("a02_document_scan", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n_chars, md5(text) AS digest,
  length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents""")
def a02(spark, folder):
    docs = table_documents(Tables(spark, folder).documents, "doc_id", "text")
    return docs.select("doc_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"),
                       F.size(F.split("text", "\n", -1)).alias("n_lines"))


@named("a03_catalog_columns", _COLUMNS_SQL + "SELECT table_name, pos, column_name, data_type, true AS nullable FROM columns_of")
def a03(spark, folder):
    return catalog.catalog_columns(spark, _all(spark, folder)).drop("column_default")


@named("a04_row_counts", _COUNTS_SQL)
def a04(spark, folder):
    return row_counts(_all(spark, folder))


@named("a05_catalog_markdown", _COLUMNS_SQL + f""", counts AS ({_COUNTS_SQL})
SELECT table_name, '## ' || table_name || chr(10) || chr(10) || 'Estimated row count: ~' || CAST(any_value(row_count) AS VARCHAR) || chr(10) || chr(10)
  || '| Column | Type | Nullable | Default |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
  || string_agg('| ' || column_name || ' | ' || data_type || ' | YES |  |' || chr(10), '' ORDER BY pos) || chr(10) AS markdown
FROM columns_of JOIN counts USING (table_name) GROUP BY table_name""")
def a05(spark, folder):
    tables = _all(spark, folder)
    return catalog.table_markdown(catalog.catalog_columns(spark, tables), row_counts(tables))


@named("a06_column_type_profile", _COLUMNS_SQL + """
SELECT table_name, count(*) FILTER (data_type = 'string') AS n_text,
  count(*) FILTER (data_type IN ('int', 'bigint', 'double')) AS n_numeric, count(*) FILTER (data_type = 'timestamp_ntz') AS n_date,
  count(*) FILTER (data_type = 'array<float>') AS n_other FROM columns_of GROUP BY table_name""")
def a06(spark, folder):
    return catalog.type_profile(catalog.catalog_columns(spark, _all(spark, folder)))


def part_documents(spark, folder):
    """One schema document per part: overview, two sections, value list, one example."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    text = F.concat(
        F.lit("# Part "), key, F.lit("\n\nThe "), name, F.lit(" of "), "p_brand", F.lit(".\n\n## part_"), key,
        F.lit("\n\n| Column | Value |\n| --- | --- |\n| size | "), F.col("p_size").cast("string"), F.lit(" |\n\n### Note\ninside\n\n## Prices of "), name,
        F.lit("\n\nRetail price."), F.lit("\n\n# Known Categorical Values\n\n**type:** "), "p_type",
        F.lit("\n\n# Example Queries\n\n<example>\n<question>What does "), name, F.lit(" No. "), key,
        F.lit(" cost?</question>\n<thought_process>Look it up.</thought_process>\n<sql>\nSELECT p_retailprice FROM part WHERE p_partkey = "),
        key, F.lit(";\n</sql>\n</example>\n"))
    return Tables(spark, folder).spread("part").select(key.alias("doc_id"), text.alias("text"))


@named("a07_chunk_split", """
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_name, p_brand, p_type, p_size, chr(10) AS nl FROM part),
q AS (SELECT *, 'What does ' || p_name || ' No. ' || k || ' cost?' AS question, '# Part ' || k || nl || nl || 'The ' || p_name || ' of ' || p_brand || '.' AS over_text,
  '## part_' || k || nl || nl || '| Column | Value |' || nl || '| --- | --- |' || nl || '| size | ' || p_size || ' |' || nl || nl || '### Note' || nl || 'inside' AS t1,
  '## Prices of ' || p_name || nl || nl || 'Retail price.' AS t2 FROM p)
SELECT k AS doc_id, 0 AS pos, 'example:what-does-' || replace(p_name, ' ', '-') || '-no-' || k || '-cost' AS chunk_id, 'EXAMPLE' AS kind, question AS title,
  'Question: ' || question || nl || nl || 'SQL:' || nl || '```sql' || nl || 'SELECT p_retailprice FROM part WHERE p_partkey = ' || k || ';' || nl || '```' AS content,
  question AS embed_text FROM q
UNION ALL SELECT k, 1, 'enum:categorical-values', 'ENUM', 'Known categorical values', '**type:** ' || p_type, '**type:** ' || p_type FROM q
UNION ALL SELECT k, 2, 'overview', 'OVERVIEW', 'Schema Overview', over_text, over_text FROM q
UNION ALL SELECT k, 3, 'table:part-' || k, 'TABLE', 'part_' || k, t1, t1 FROM q
UNION ALL SELECT k, 4, 'table:prices-of-' || replace(p_name, ' ', '-'), 'TABLE', 'Prices of ' || p_name, t2, t2 FROM q""")
def a07(spark, folder):
    return corpus.split_documents(part_documents(spark, folder))


def framed_documents(spark, folder):
    """Each document's whole text between a title and one table section."""
    text = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n## "), "source", F.lit("\n\nLanguage "), "lang")
    return Tables(spark, folder).spread("documents").select(F.col("doc_id"), text.alias("text"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("ns"))


@named("a07_chunk_split_documents", r"""
SELECT doc_id, 0 AS pos, 'overview' AS chunk_id, 'OVERVIEW' AS kind, length(content) AS n_chars, md5(content) AS digest
FROM (SELECT doc_id, regexp_replace('# Document ' || doc_id || chr(10) || chr(10) || text, '^\s+|\s+$', '', 'g') AS content FROM documents)
UNION ALL SELECT doc_id, 1, 'table:' || source, 'TABLE', length(content), md5(content)
FROM (SELECT doc_id, source, '## ' || source || chr(10) || chr(10) || 'Language ' || lang AS content FROM documents)""")
def a07_documents(spark, folder):
    chunks = corpus.split_documents(framed_documents(spark, folder))
    return chunks.select("doc_id", "pos", "chunk_id", "kind", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


@named("a08_slug_ids", """
SELECT doc_id, rtrim(substring(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-') AS slug FROM documents""")
def a08(spark, folder):
    return Tables(spark, folder).spread("documents").select("doc_id", slug("text").alias("slug"))


_SAMPLED = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
    "pages": ("page_id", ["page_id", "url", "html"]),
    "benchmark": ("item_id", ["item_id", "text"]),
    "labels": ("doc_id", ["doc_id", "quality", "toxic"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "lineitem": ("l_orderkey, l_linenumber", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "embeddings": ("vec_id", ["vec_id", "label"]),
    "conversations": ("conv_id, turn", ["conv_id", "turn", "role", "text"]),
}


def _sample_sql(name):
    key, cols = _SAMPLED[name]
    head = "| " + " | ".join(cols) + " | "
    rule = "|" + " --- |" * len(cols)
    cell = "replace(CASE WHEN length(CAST({0} AS VARCHAR)) > 120 THEN substring(CAST({0} AS VARCHAR), 1, 117) || '...' ELSE coalesce(CAST({0} AS VARCHAR), 'NULL') END, '|', '\\|')"
    line = " || ' | ' || ".join(cell.format(c) for c in cols)
    return (f"SELECT 'table:{name}' AS chunk_id, 'Rows of {name}' || chr(10) || chr(10) || '### Sample rows' || chr(10) || chr(10) || '{head}' || chr(10) || '{rule}' || chr(10) || "
            f"(SELECT string_agg('| ' || line || ' |', ' ' || chr(10) ORDER BY k) FROM (SELECT row_number() OVER (ORDER BY {key}) AS k, {line} AS line FROM {name} ORDER BY {key} LIMIT 3)) AS content")


@named("a09_sample_rows", " UNION ALL ".join(_sample_sql(n) for n in _SAMPLED)
       + " UNION ALL SELECT 'table:none', 'Rows of none' UNION ALL SELECT DISTINCT 'enum:' || lang, 'Language ' || lang FROM documents")
def a09(spark, folder):
    t = Tables(spark, folder)
    samples = None
    for name, (key, cols) in _SAMPLED.items():
        one = corpus.sample_markdown(name, t.scan(name).select(*cols), key.split(", "))
        samples = one if samples is None else samples.unionByName(one)
    names = catalog.catalog_columns(spark, {n: t.scan(n) for n in _SAMPLED}).select("table_name").distinct()
    chunks = names.select(F.concat(F.lit("table:"), "table_name").alias("chunk_id"), F.lit("TABLE").alias("kind"),
                          F.concat(F.lit("`"), "table_name", F.lit("`")).alias("title"), F.concat(F.lit("Rows of "), "table_name").alias("content"))
    other = t.documents.select("lang").distinct().select(F.concat(F.lit("enum:"), "lang").alias("chunk_id"), F.lit("ENUM").alias("kind"),
                                                         F.lit("region").alias("title"), F.concat(F.lit("Language "), "lang").alias("content"))
    absent = names.limit(1).select(F.lit("table:none").alias("chunk_id"), F.lit("TABLE").alias("kind"), F.lit("none").alias("title"), F.lit("Rows of none").alias("content"))
    return corpus.enrich_tables(chunks.unionByName(other).unionByName(absent), samples).select("chunk_id", "content")


_DIM = 64


@named("a10_hash_embedding", rf"""
WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS w FROM documents),
counts AS (SELECT doc_id, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % {_DIM} AS bucket, count(*) AS n FROM words WHERE length(w) > 1 GROUP BY 1, 2),
norms AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM counts GROUP BY 1)
SELECT doc_id, bucket, CAST(CAST(n / norm AS FLOAT) AS DOUBLE) AS weight FROM counts JOIN norms USING (doc_id)""")
def a10(spark, folder):
    vectors = corpus.embed_by_hash(Tables(spark, folder).spread("documents").select("doc_id", "text"), "text", _DIM, bucket=corpus.portable_bucket)
    return (vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0")
            .select("doc_id", "bucket", F.col("weight").cast("double").alias("weight")))


def document_chunks(spark, folder):
    return Tables(spark, folder).documents.select(
        F.col("lang").alias("namespace"), F.col("source").alias("chunk_id"), F.lit("TABLE").alias("kind"), F.col("source").alias("title"),
        F.col("text").alias("content"), F.timestamp_seconds("doc_id").alias("created_at"), "doc_id")


@named("a11_reset_namespace", "SELECT doc_id, lang AS namespace, md5(text) AS digest FROM documents WHERE lang <> 'en'")
def a11(spark, folder):
    kept = corpus.reset_namespace(document_chunks(spark, folder), "en")
    return kept.select("doc_id", "namespace", F.md5(F.col("content").cast("binary")).alias("digest"))


@named("a12_upsert", """
WITH incoming AS (SELECT d.*, 1 AS batch FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1),
all_rows AS (SELECT lang, source, text, doc_id, doc_id AS born, 0 AS batch FROM documents UNION ALL SELECT lang, source, text, doc_id, doc_id + 1000000, 1 FROM incoming)
SELECT lang AS namespace, source AS chunk_id, arg_max(text, batch * 1000000000000 + doc_id) AS content, min(born) AS created_s FROM all_rows GROUP BY 1, 2""")
def a12(spark, folder):
    t = Tables(spark, folder)
    base = document_chunks(spark, folder)
    stored = corpus.last_in_batch(base, ["doc_id"]).drop("doc_id")
    # The stored row of a key is its latest; its creation time is that of its first arrival.
    first = base.groupBy("namespace", "chunk_id").agg(F.min("created_at").alias("first_at"))
    stored = stored.join(first, ["namespace", "chunk_id"]).withColumn("created_at", F.col("first_at")).drop("first_at")
    good = t.labels.where("quality = 1").select("doc_id")
    incoming = base.join(good, "doc_id").withColumn("created_at", F.timestamp_seconds(F.col("doc_id") + 1_000_000))
    return corpus.upsert(stored, incoming, ["doc_id"]).select("namespace", "chunk_id", "content", F.unix_seconds("created_at").alias("created_s"))


_BUCKETS = 48


# A store of all documents, then two upserts; the version of a row's bucket tells which of them rewrote it.
@named("a12_bucketed_upsert", f"""
WITH c AS (SELECT lang AS namespace, source || '/' || d.doc_id AS chunk_id, text, d.doc_id, coalesce(quality, 0) AS good, coalesce(toxic, 0) AS bad FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
b AS (SELECT *, CAST('0x' || substring(md5(namespace || '/' || chunk_id), 1, 8) AS BIGINT) % {_BUCKETS} AS bucket FROM c),
v AS (SELECT bucket, CASE WHEN max(bad) = 1 THEN 2 ELSE 1 END AS version FROM b GROUP BY bucket)
SELECT namespace, chunk_id, md5(CASE WHEN bad = 1 THEN 'withheld' ELSE text END) AS digest, doc_id AS created_s, CAST(version AS INTEGER) AS version FROM b JOIN v USING (bucket)""")
def a12_bucketed(spark, folder):
    t = Tables(spark, folder)
    base = document_chunks(spark, folder).withColumn("chunk_id", F.concat_ws("/", "chunk_id", F.col("doc_id").cast("string")))
    fields = base.drop("doc_id").schema
    store = ChunkStore.create(spark, fresh_path(spark, "chunk-store"), fields, _BUCKETS)
    store.upsert(base, ["doc_id"])
    toxic = base.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id").withColumn("content", F.lit("withheld"))
    store.upsert(toxic.withColumn("created_at", F.timestamp_seconds(F.col("doc_id") + 1_000_000)), ["doc_id"])
    rows = store.read().withColumn("bucket", store.bucket()).join(store.versions(), "bucket")
    return rows.select("namespace", "chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"), F.unix_seconds("created_at").alias("created_s"), "version")


@named("a13_ingest_summary", """
SELECT namespace, kind, n_chunks, sum(n_chunks) OVER (PARTITION BY namespace) AS n_total
FROM (SELECT lang AS namespace, source AS kind, count(*) AS n_chunks FROM documents GROUP BY 1, 2)""")
def a13(spark, folder):
    chunks = document_chunks(spark, folder).withColumn("kind", F.col("chunk_id"))
    return corpus.ingest_summary(chunks).withColumn("n_total", F.col("n_total").cast("bigint"))


# Every document is a namespace, so that all chunks are kept.
@named("a14_ingest_job", r"""
SELECT lang || '/' || source || '/' || doc_id AS namespace, 'OVERVIEW' AS kind, 1 AS n_chunks,
  regexp_replace('# Document ' || doc_id || chr(10) || chr(10) || text, '^\s+|\s+$', '', 'g') AS content, 2 AS n_total FROM documents
UNION ALL SELECT lang || '/' || source || '/' || doc_id, 'TABLE', 1, '## ' || source || chr(10) || chr(10) || 'Language ' || lang, 2 FROM documents""")
def a14(spark, folder):
    docs = framed_documents(spark, folder)
    chunks = ingest(docs, spark.createDataFrame([], STORED_SCHEMA), F.col("ns"), F.timestamp_seconds(F.lit(0)), dim=_DIM)
    chunks = materialise(chunks, "chunks")  # what follows reads the stored table, not the documents
    content = chunks.where("embedding IS NOT NULL").select("namespace", "kind", "content")
    return corpus.ingest_summary(chunks).join(content, ["namespace", "kind"])


# All documents, then the good ones again with sample rows, after the English ones have been taken out.
@named("a14_samples_and_reset", rf"""
WITH d AS (SELECT d.doc_id, lang, text, CASE WHEN d.doc_id % 2 = 0 THEN 'nation' ELSE 'region' END AS t, coalesce(quality, 0) = 1 AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
samples AS (SELECT 'nation' AS t, substring(content, 15) AS s FROM ({_sample_sql("nation")}) UNION ALL SELECT 'region', substring(content, 15) FROM ({_sample_sql("region")})),
c AS (SELECT lang, 'overview' AS chunk_id, doc_id, good, regexp_replace('# Document ' || doc_id || chr(10) || chr(10) || text, '^\s+|\s+$', '', 'g') AS plain, '' AS s FROM d
  UNION ALL SELECT lang, 'table:' || d.t, doc_id, good, '## ' || d.t || chr(10) || chr(10) || 'Language ' || lang, samples.s FROM d JOIN samples USING (t)),
k AS (SELECT lang, chunk_id, bool_or(good) AS again, arg_max(plain, doc_id) AS first, arg_max(plain || s, doc_id) FILTER (good) AS second FROM c GROUP BY 1, 2)
SELECT lang AS namespace, chunk_id, md5(CASE WHEN again THEN second ELSE first END) AS digest, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS created_s FROM k WHERE again OR lang <> 'en'""")
def a14_samples(spark, folder):
    t = Tables(spark, folder)
    table = F.when(F.col("doc_id") % 2 == 0, "nation").otherwise("region")
    text = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n## "), table, F.lit("\n\nLanguage "), "lang")
    docs = t.spread("documents").select("doc_id", text.alias("text"), F.col("lang").alias("ns"))
    store = ChunkStore.create(spark, fresh_path(spark, "sampled-store"), spark.createDataFrame([], STORED_SCHEMA).schema, _BUCKETS)
    ingest_into(store, docs, F.col("ns"), F.timestamp_seconds(F.lit(1)), dim=_DIM)
    samples = reduce(DataFrame.unionByName, [corpus.sample_markdown(n, t.scan(n).select(*_SAMPLED[n][1]), _SAMPLED[n][0].split(", ")) for n in ("nation", "region")])
    good = docs.join(t.labels.where("quality = 1").select("doc_id"), "doc_id")
    ingest_into(store, good, F.col("ns"), F.timestamp_seconds(F.lit(2)), reset="en", samples=samples, dim=_DIM)
    return store.read().select("namespace", "chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"), F.unix_seconds("created_at").alias("created_s"))
