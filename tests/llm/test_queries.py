"""The registered queries beside their SQL, and the pipeline beside its parts."""

import re

import pytest

import corpus_pipeline
from guardedlake.llm import decontaminate, quality_rules, superminhash
from guardedlake.llm.queries import QUERIES
from guardedlake.llm.sql import SQL
from tools.check import oracle, row_set


@pytest.mark.parametrize("name", list(SQL))
def test_query_and_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    cur = oracle(data).execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert row_set(df.columns, [tuple(r) for r in df.collect()]) == row_set(names, cur.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_has_a_row_for_each_document(spark, docs, data, name):
    rows = QUERIES[name](spark, data).collect()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} <= ids if name.startswith("op1_") else sorted(r["doc_id"] for r in rows) == sorted(ids)


def test_registration():
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, docs, data):
    """Each stage's rows are what its operator says of the stage before."""
    before, benchmark = docs, spark.read.parquet(f"{data}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, data).cache()
        kept[name] = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "quality":
            assert kept[name] == {r["doc_id"] for r in quality_rules.quality_rules(before).where("quality.kept").collect()}
        elif name == "near_duplicates":
            assert kept[name] == {r["doc_id"] for r in superminhash.near_duplicates(before).where("kept").collect()}
        elif name == "decontamination":
            assert kept[name] == {r["doc_id"] for r in before.select("doc_id").collect()} - {r["_id"] for r in decontaminate.contaminated(before, benchmark).collect()}
        if name != "tokens":
            assert after.columns == docs.columns
            before = after
    assert kept["tokens"] == kept["personal_data"] == kept["decontamination"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(texts[r["doc_id"]] == r["text"] and r["n_tokens"] == len(r["ids"]) for r in after.collect())
    assert not any(re.search(r"@[a-z0-9]+\.example\.com", t) for t in texts.values())


def test_pipeline_of_odd_and_empty_rows(spark, odd, empty, data):
    for table in (odd, empty):
        df = table
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, data)
            assert name == "tokens" or df.columns == table.columns
        assert df.count() <= table.count()
