"""Joins that move only rows which may match, and steps that hold little at a time."""

import base64
import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from guardedlake.llm import collocations, decontaminate, pii, sieve, superminhash, warc
from guardedlake.llm.sieve import may_match
from tests.conftest import plan, rows


@pytest.fixture
def nothing_sent(spark):
    """A session that has to shuffle whatever it joins."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_sieve_holds_all_matches_and_few_others(spark):
    keys = spark.createDataFrame([(i, None if i % 2 else i) for i in range(0, 9_000, 9)] + [(None, None)], "a bigint, b bigint")
    table = spark.range(9_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("b")).union(spark.createDataFrame([(None, None)], "id bigint, b bigint"))
    through = {r[0] for r in rows(table.where(may_match(keys, ["a", "b"])("id", "b")))}
    assert {*range(0, 9_000, 9), None} <= through and len(through) < 1_300
    assert not rows(table.where(may_match(keys.where("false"), ["a", "b"])("id", "b")))


def test_sieve_holds_all_matches_however_full_its_table_is(spark, monkeypatch):
    monkeypatch.setattr(sieve, "MOST_BITS", sieve.LEAST_BITS)
    keys = spark.range(0, 300_000, 3).select(F.col("id").alias("a"))
    seen = may_match(keys, ["a"])("id")
    table = spark.range(300_000)
    through, rest = table.where(seen), table.where(~seen)
    assert through.where("id % 3 = 0").count() == 100_000 and through.count() + rest.count() == 300_000 and rest.count() > 20_000


def test_personal_data_is_marked_by_spark_alone(spark, odd, nothing_sent):
    """The plans that are run for a redaction hold no Python, and in none are texts sent or shuffled that can't match."""
    out = pii.redact(odd)
    assert not re.search("Python|Pandas|Arrow", plan(out))
    assert not re.search("Python|Pandas|Arrow", plan(odd.where(may_match(odd, ["doc_id"])("doc_id"))))
    assert "hashpartitioning" not in plan(odd.where(~may_match(odd, ["doc_id"])("doc_id")))
    assert out.count() == odd.count()


def test_only_texts_that_may_match_are_shuffled(spark, nothing_sent):
    item = " ".join(f"w{i}" for i in range(40))
    plain = [(i, " ".join(f"p{i}x{j}" for j in range(12))) for i in range(30)]
    docs = spark.createDataFrame([*plain, (100, f"a b {item} c d"), (101, f"{plain[3][1]}"), (None, "mail x@y.zz now"), (102, "mail a@b.cc now"), (103, None)], "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    clean, one, marked = decontaminate.clean(docs, bench), superminhash.one_of_each(docs), pii.redact(docs)
    ids = sorted((r[0] for r in rows(docs.select("doc_id"))), key=str)
    assert sorted((r[0] for r in rows(clean.select("doc_id"))), key=str) == [i for i in ids if i != 100]
    assert sorted((r[0] for r in rows(one.select("doc_id"))), key=str) == [i for i in ids if i != 101]
    assert {r[0]: r[1] for r in rows(marked.where("text LIKE 'mail%'").select("doc_id", "text"))} == {None: "mail [EMAIL] now", 102: "mail [EMAIL] now"}
    assert len(rows(marked)) == len(ids)
    # Texts that can't match take a branch of their own.
    assert all("Union" in plan(df) for df in (clean, one, marked))


def test_page_digest_is_computed_once_for_a_row(spark):
    df = warc.payloads(spark.createDataFrame([(1, "u", "é"), (2, "u", None)], "page_id bigint, url string, html string"))
    want = [base64.b32encode(hashlib.sha1(x.encode()).digest()).decode() for x in ("é", "")]
    assert [r["digest"] for r in df.orderBy("page_id").collect()] == want
    assert df.groupBy("digest").count()._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1


def test_phrases_are_spelled_out_a_few_at_a_time():
    rng = np.random.default_rng(0)
    text = " ".join(f"word{i}" for i in rng.integers(0, 500_000, 300_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array([text])], ["doc_id", "lang", "text"])
    everything = [np.full(1 << 13, 255, dtype=np.uint8)] * 4
    tracemalloc.start()
    n = sum(pa.compute.sum(out.column(2)).as_py() for out in collocations._phrases(everything)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(300_000 - k for k in range(4)) and peak < 60 * len(text)
