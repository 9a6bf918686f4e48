"""Named queries, each with the independent SQL it is checked against, if there is one."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Named(NamedTuple):
    run: Run
    sql: str | None


NAMED: dict[str, Named] = {}


def named(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under a name."""
    def keep(run: Run) -> Run:
        if name in NAMED:
            raise ValueError(f"two queries named {name}")
        NAMED[name] = Named(run, sql)
        return run

    return keep
