import numpy as np
from pyspark.sql import functions as F

from guardedlake.functions.text import sample_cell, slug
from guardedlake.operators import corpus
from guardedlake.plans.ingest import STORED_SCHEMA, ingest, store
from guardedlake.sources import catalog
from guardedlake.sources.documents import read_documents, read_lines
from tests.conftest import rows

EX = "<example>\n<question>{}</question>\n{}<sql>\nSELECT 1;\n</sql>\n</example>\n"
DOC = ("# Title\n\nIntro.\n\n## orders\nRows.\n### Inner\nx\n\n## `my table`\nMore.\n\n# Known categorical values\n\n**a:** 1\n\n# Relations\n\n- a to b\n\n"
       "# Example Queries\n\n" + EX.format("How many?", "") + EX.format("Which one?", "<thought_process>hm</thought_process>\n"))


def split(spark, text, strict=False):
    df = corpus.split_documents(spark.createDataFrame([("d", text)], "doc_id string, text string"), strict)
    return [(r["kind"], r["chunk_id"], r["content"]) for r in df.orderBy("pos").collect()]


def test_split_keeps_every_part(spark):
    got = split(spark, DOC)
    assert [g[:2] for g in got] == [("EXAMPLE", "example:how-many"), ("EXAMPLE", "example:which-one"), ("ENUM", "enum:categorical-values"),
                                    ("OVERVIEW", "overview"), ("TABLE", "table:orders"), ("TABLE", "table:my-table")]
    assert got[0][2] == "Question: How many?\n\nSQL:\n```sql\nSELECT 1;\n```"
    assert got[2][2] == "**a:** 1"
    assert got[3][2] == "# Title\n\nIntro.\n\n# Relations\n\n- a to b"
    assert got[4][2] == "## orders\nRows.\n### Inner\nx" and got[5][2] == "## `my table`\nMore."


def test_strict_split(spark):
    got = split(spark, DOC, strict=True)
    assert [g[:2] for g in got] == [("EXAMPLE", "example:how-many"), ("ENUM", "enum:categorical-values"), ("OVERVIEW", "overview"),
                                    ("TABLE", "table:orders"), ("TABLE", "table:my-table")]
    assert got[2][2] == "# Title\n\nIntro." and "# Relations" in got[4][2] and "Which one?" in got[4][2]


def test_split_edges(spark):
    assert split(spark, "  \n ") == [] and split(spark, None) == []
    assert split(spark, "just text") == [("OVERVIEW", "overview", "just text")]
    assert split(spark, "## a\nx") == [("TABLE", "table:a", "## a\nx")]
    assert split(spark, "# Known Categorical Values\n\n  \n") == []
    assert split(spark, "intro\n\n# KNOWN categorical VALUES\nv: 1") == [("ENUM", "enum:categorical-values", "v: 1"), ("OVERVIEW", "overview", "intro")]
    assert [g[1] for g in split(spark, "## A b\nx\n## a-B\ny\n## éü\nz")] == ["table:a-b", "table:a-b", "table:"]


def test_slug(spark):
    df = spark.createDataFrame([("Hello, World!",), ("--a--",), ("x" * 79 + " yz",), ("é",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(slug("t")).collect()] == ["hello-world", "a", "x" * 79, ""]


def test_sample_rows(spark):
    t = spark.createDataFrame([(2, "b|c"), (1, None), (3, "z" * 121), (4, "no")], "id int, v string")
    samples = corpus.sample_markdown("t", t, ["id"]).unionByName(corpus.sample_markdown("empty", t.where("id > 9"), ["id"]))
    chunks = spark.createDataFrame([("1", "TABLE", "`t`", "c"), ("2", "TABLE", "empty", "c"), ("3", "TABLE", "my table", "c"), ("4", "ENUM", "t", "c"), ("5", "TABLE", "gone", "c")],
                                   "chunk_id string, kind string, title string, content string")
    got = dict(rows(corpus.enrich_tables(chunks, samples).select("chunk_id", "content")))
    assert got["1"] == "c\n\n### Sample rows\n\n| id | v | \n| --- | --- |\n| 1 | NULL | \n| 2 | b\\|c | \n| 3 | " + "z" * 117 + "... |"
    assert {k: v for k, v in got.items() if k != "1"} == {"2": "c", "3": "c", "4": "c", "5": "c"}
    cells = spark.createDataFrame([("y" * 120,), ("y" * 118 + "|||",)], "v string").coalesce(1).select(sample_cell("v")).collect()
    assert [c[0] for c in cells] == ["y" * 120, "y" * 117 + "..."]


def test_embedding_order_and_blanks(spark):
    def encoder(texts):
        assert len(texts) <= 2
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "z"), (5, "yy")], "id int, t string").coalesce(1)
    assert rows(corpus.embed(df, "t", encoder, batch=2).select("id", "embedding")) == [(1, [3.0, 1.0]), (2, None), (3, None), (4, [1.0, 1.0]), (5, [2.0, 1.0])]
    hashed = rows(corpus.embed_by_hash(df.select("id", F.lit("aa bb aa").alias("t")), "t", 16).select("embedding"))
    assert all(abs(np.linalg.norm(v[0]) - 1) < 1e-6 for v in hashed)
    assert rows(corpus.embed_by_hash(df.where("id = 2"), "t", 16).select("embedding")) == [(None,)]


def test_encoder_runs_once_per_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return np.ones((len(texts), 2))

    df = corpus.embed(spark.range(10).select(F.col("id").cast("string").alias("t")), "t", encoder)
    df.select(F.explode("embedding")).where("col > 0").count()
    assert seen.value == 10


def docs(spark, *pairs):
    return spark.createDataFrame(pairs, "doc_id string, text string")


def test_ingest_upserts_and_is_idempotent(spark):
    empty = spark.createDataFrame([], STORED_SCHEMA)
    first = ingest(docs(spark, ("a", "## t\nold\n## gone\nx")), empty, "ns", F.timestamp_seconds(F.lit(1)), dim=8)
    path = store(first)
    stored = spark.read.schema(STORED_SCHEMA).parquet(path)
    new = docs(spark, ("b", "## t\nnew"))
    second = ingest(new, stored, "ns", F.timestamp_seconds(F.lit(2)), dim=8)
    got = sorted((r["chunk_id"], r["content"], r["created_at"].timestamp()) for r in second.collect())
    assert got == [("table:gone", "## gone\nx", 1.0), ("table:t", "## t\nnew", 1.0)]
    again = ingest(new, spark.read.schema(STORED_SCHEMA).parquet(store(second)), "ns", F.timestamp_seconds(F.lit(3)), dim=8)
    assert sorted((r["chunk_id"], r["content"], r["created_at"].timestamp()) for r in again.collect()) == got
    reset = ingest(new, stored, "ns", F.timestamp_seconds(F.lit(4)), reset="ns", dim=8)
    assert [(r["chunk_id"], r["created_at"].timestamp()) for r in reset.collect()] == [("table:t", 4.0)]


def test_same_slug_keeps_the_later_chunk(spark):
    out = ingest(docs(spark, ("a", "## A b\n1\n## a-b\n2")), spark.createDataFrame([], STORED_SCHEMA), "ns", F.timestamp_seconds(F.lit(1)), dim=8)
    assert [(r["chunk_id"], r["content"]) for r in out.collect()] == [("table:a-b", "## a-b\n2")]


def test_files_and_catalog_document(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n\nx\n")
    assert rows(read_documents(spark, str(tmp_path)).select("text")) == [("# A\n\nx\n",)]
    try:
        read_documents(spark, str(tmp_path / "none")).collect()
        raise AssertionError("a missing file has to raise")
    except Exception as failure:
        assert "PATH_NOT_FOUND" in str(failure) or "does not exist" in str(failure)
    (tmp_path / "a.md").write_text("event: a\r\ndata: 1\n\n")
    assert [r["line"] for r in read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["event: a", "data: 1", "", ""]
    t = spark.createDataFrame([(1, "x")], "id int, v string")
    cols = catalog.catalog_columns(spark, {"b": t, "a": t})
    doc = catalog.catalog_markdown(catalog.table_markdown(cols)).first()["text"]
    assert doc.startswith("# Database Schema Reference\n\nAuto-generated from the catalog.\n\n## a\n\n| Column | Type | Nullable | Default |\n")
    assert [c[1] for c in split(spark, doc)] == ["overview", "table:a", "table:b"]
