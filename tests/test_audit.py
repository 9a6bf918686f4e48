import re

import pytest
from pyspark.sql import functions as F

from guardedlake.operators import quality
from guardedlake.plans.all_queries import NAMED
from tests.conftest import plan, rows

KEY = quality.ForeignKey


def separate(tables, rules):
    """The same counts by plain Python loops over the collected tables."""
    data = {t: [r.asDict() for r in df.collect()] for t, df in tables.items()}
    out = []
    for t, of in rules.items():
        for cols in of.unique:
            keys = [tuple(r[c] for c in cols) for r in data[t] if all(r[c] is not None for c in cols)]
            out.append((t, f"unique({', '.join(cols)})", len(keys) - len(set(keys))))
        for f in of.foreign:
            parents = {str(r[f.parent_col]) for r in data[f.parent] if r[f.parent_col] is not None}
            out.append((t, f"foreign_key({f.col})", sum(r[f.col] is not None and str(r[f.col]) not in parents for r in data[t])))
    return sorted(out)


def test_key_rules_against_loops(spark):
    child = spark.createDataFrame([(i, None if i % 11 == 0 else i % 40, "a" * (i % 5) if i % 7 else None, str(i % 50), i % 3) for i in range(400)] + [(1, 7, "1:a", "x", None)] * 3,
                                  "id int, p int, name string, num string, z smallint")
    parent = spark.createDataFrame([(i, "a" * i) for i in range(3, 30)] + [(None, None), (5, "aa")], "k bigint, name2 string")
    rules = {"child": quality.TableRules((), (("id",), ("name", "z"), ("p", "num")), (KEY("p", "parent", "k"), KEY("name", "parent", "name2"), KEY("num", "parent", "k"), KEY("z", "child", "id"))),
             "parent": quality.TableRules(unique=(("k",),))}
    tables = {"child": child, "parent": parent}
    assert sorted(rows(quality.audit_tables(tables, rules))) == separate(tables, rules)


def test_joined_parts_are_not_taken_for_each_other(spark):
    df = spark.createDataFrame([("a:1", "b"), ("a", "1:b"), ("1", "1:1"), ("1:1", "1")], "a string, b string")
    binary = spark.createDataFrame([(bytearray(b"\xff\xfe"),), (bytearray(b"\xff\xfd"),)], "b binary")
    got = quality.audit_tables({"t": df, "u": binary}, {"t": quality.TableRules(unique=(("a", "b"),)), "u": quality.TableRules(unique=(("b",),))})
    assert sorted(rows(got)) == [("t", "unique(a, b)", 0), ("u", "unique(b)", 0)]


def test_row_rules_parents_by_condition_and_empty_tables(spark):
    t = spark.createDataFrame([(1, "x"), (2, None), (3, "long")], "id int, s string")
    parent = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, good boolean")
    rules = {"t": quality.TableRules((quality.not_null("s"), quality.max_length("s", 2), quality.one_of("s", ["x"])), foreign=(KEY("id", "p", "id", F.col("good")),))}
    got = {r: n for _, r, n in rows(quality.audit_tables({"t": t, "p": parent}, rules))}
    assert got == {"not_null(s)": 1, "length(s)": 1, "check(s)": 1, "foreign_key(id)": 2}
    empty = {r: n for _, r, n in rows(quality.audit_tables({"t": t.where("false"), "p": parent.where("false")}, rules))}
    assert empty == dict.fromkeys(got, 0)
    with pytest.raises(ValueError, match="no rules"):
        quality.audit_tables({"t": t}, {})
    with pytest.raises(KeyError):
        quality.audit_tables({"t": t}, {"t": quality.TableRules(foreign=(KEY("id", "none", "id"),))})


def test_one_scan_a_table_no_join_and_counts_before_the_shuffle(spark, data):
    text = plan(NAMED["h01_constraint_audit"].run(spark, data)).split("== Physical Plan ==")[1]
    for table in ("orders", "lineitem", "customer", "part", "supplier", "nation", "region", "events"):
        assert len(re.findall(rf"FileScan[^\n]*/{table}\.parquet", text)) == 1, table
    assert "Join" not in text and "partial_count_if" in text or "partial_count" in text


def test_a_hot_key_is_one_row_a_task(spark):
    hot = spark.range(0, 300_000, 1, 4).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    got = quality.audit_tables({"t": hot, "p": spark.range(10)}, {"t": quality.TableRules((), (("k",),), (KEY("k", "p", "id"),))})
    # Multiples of three became 7: 100,000 of them, and 7 itself.
    assert sorted(rows(got)) == [("t", "foreign_key(k)", 200_000 - 6), ("t", "unique(k)", 100_000)]
