"""Every named query beside its SQL on the smallest tables."""

import pytest

from guardedlake.plans.all_queries import NAMED
from tools.check import compare, oracle


@pytest.fixture(scope="module")
def con(data):
    return oracle(data)


@pytest.mark.parametrize("name", list(NAMED))
def test_named_query(spark, con, data, name):
    status, n, _, note = compare(spark, con, name, data)
    assert status in ("ok", "rows"), f"{status} {note}"
    assert n >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    shown = e.entry(spark).collect()
    assert len(shown) == 1 and shown[0]["markdown"].startswith("| business_unit | total_revenue | \n| --- | --- | \n")
    assert shown[0]["markdown"].endswith("_10 row(s) returned_") and "| 11483405.93 | " in shown[0]["markdown"]
