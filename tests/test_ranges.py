import random

import pytest
from pyspark.sql import functions as F

from guardedlake.operators.ranges import range_join
from tests.conftest import plan, rows

EDGE = 2 ** 63


def brute(points, ranges, left):
    out = []
    for i, v in points:
        hit = [(i, v, a, z, n) for a, z, n in ranges if v is not None and (a is None or a <= v) and (z is None or v <= z)]
        out += hit or ([(i, v, None, None, None)] if left else [])
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_against_all_pairs(spark, how):
    pick = random.Random(5)
    values = [0, -1, 1, EDGE - 1, -EDGE, None, None, 7, 7, 7] + [pick.randint(-600, 600) for _ in range(300)]
    points = list(enumerate(values))
    ranges = [(None, None, "all"), (None, -5, "low"), (5, None, "high"), (9, 3, "none"), (7, 7, "one"), (7, 7, "one"), (-EDGE, EDGE - 1, "whole")]
    for n in range(120):
        a = pick.randint(-600, 600)
        ranges.append((a, a + pick.choice([0, 1, 2, 3, 8, 31, 32, 33, 500]), f"r{n}"))
    p = spark.createDataFrame(points, "id int, v bigint")
    r = spark.createDataFrame(ranges, "a bigint, z bigint, name string")
    got = range_join(p, "v", r, "a", "z", how)
    assert sorted(rows(got), key=repr) == brute(points, ranges, how == "left")
    text = plan(got)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_fractions(spark):
    p = spark.createDataFrame([(1, 1.2), (2, 1.9), (3, -0.5), (4, 3.0)], "id int, v double")
    r = spark.createDataFrame([(1.5, 3.0, "x"), (-1.0, -0.25, "y"), (-0.75, 1.5, "z")], "a double, z double, name string")
    assert sorted(rows(range_join(p, "v", r, "a", "z").select("id", "name"))) == [(1, "z"), (2, "x"), (3, "y"), (3, "z"), (4, "x")]


def test_no_ranges_no_points_and_shared_names(spark):
    p = spark.createDataFrame([(1, 5)], "id int, v bigint")
    none = spark.createDataFrame([], "a bigint, z bigint, name string")
    assert rows(range_join(p, "v", none, "a", "z")) == [] and rows(range_join(p, "v", none, "a", "z", "left")) == [(1, 5, None, None, None)]
    assert rows(range_join(p.where("false"), "v", none, "a", "z", "left")) == []
    with pytest.raises(ValueError, match="both sides"):
        range_join(p, "v", p.withColumn("z", F.lit(1)), "v", "z")
    with pytest.raises(ValueError, match="inner or left"):
        range_join(p, "v", none, "a", "z", "outer")


def test_long_ranges_make_no_more_rows_than_short_ones(spark):
    # One hot value and one range over everything: a bin per range and level, not per number.
    p = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    r = spark.createDataFrame([(0, 10 ** 12, "long"), (7, 7, "short")], "a bigint, z bigint, name string")
    got = dict(rows(range_join(p, "v", r, "a", "z").groupBy("name").count()))
    assert got == {"long": 100_000, "short": 33_335}  # 7 itself is not a multiple of 3
