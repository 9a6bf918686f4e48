"""Scope rules, response filters, and redaction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ScopeRule(NamedTuple):
    """Applies to a tenant (or all) and to questions a pattern finds; first match decides."""

    pattern: str
    allow: bool
    message: str = ""
    tenant: str | None = None


def check_scope(requests: DataFrame, rules: list[ScopeRule], text: str = "query", default_allow: bool = True) -> DataFrame:
    """Add ``in_scope`` and ``rejection`` by the first rule that matches.

    Rules are constants of the plan, so each pattern is compiled once and the
    requests are neither joined nor moved.
    """
    allow, message = F.lit(default_allow), F.lit(None).cast("string")
    for rule in reversed(rules):
        hit = F.coalesce(F.col(text).rlike(rule.pattern), F.lit(False))
        if rule.tenant is not None:
            hit = hit & F.coalesce(F.col("tenant_id") == rule.tenant, F.lit(False))
        allow = F.when(hit, rule.allow).otherwise(allow)
        message = F.when(hit, F.lit(None if rule.allow else rule.message)).otherwise(message)
    return requests.withColumn("in_scope", allow).withColumn("rejection", message)


def rejected_results(checked: DataFrame) -> DataFrame:
    """The result rows of requests out of scope: message, no rounds, score 0."""
    return (checked.where(~F.col("in_scope"))
            .select("request_id", F.col("rejection").alias("response"), F.lit(0).alias("iterations"),
                    F.lit(0.0).alias("quality_score"), F.lit(True).alias("rejected")))


class ResponseFilter(NamedTuple):
    """A rewriting column function, and the condition and reason to block, if any."""

    order: int
    rewrite: Callable[[Column], Column] | None = None
    block_if: Callable[[Column], Column] | None = None
    reason: str = ""


def apply_filters(responses: DataFrame, filters: list[ResponseFilter], text: str = "response") -> DataFrame:
    """Run the filters in order over ``text``; the first to block ends the chain.

    One struct column is threaded through the list, so all filters are one
    projection.
    """
    start = F.struct(F.col(text).alias("content"), F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("reason"))

    def step(df: DataFrame, f: ResponseFilter) -> DataFrame:
        content, done = F.col("__f.content"), F.col("__f.blocked")
        stop = F.coalesce(f.block_if(content), F.lit(False)) if f.block_if else F.lit(False)
        fresh = f.rewrite(content) if f.rewrite else content
        return df.withColumn("__f", F.when(done, F.col("__f")).otherwise(F.struct(
            F.when(stop, None).otherwise(fresh).alias("content"), stop.alias("blocked"),
            F.when(stop, f.reason).alias("reason"))))

    out = reduce(step, sorted(filters, key=lambda f: f.order), responses.withColumn("__f", start))
    shown = F.when(F.col("__f.blocked"), F.concat(F.lit("Response blocked: "), "__f.reason")).otherwise(F.col("__f.content"))
    return out.withColumn(text, shown).withColumn("blocked", F.col("__f.blocked")).drop("__f")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
PHONE = r"\+?[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"


def redact(text: Column | str) -> Column:
    """E-mail addresses, card-like and phone-like numbers replaced by their kind."""
    out = F.col(text) if isinstance(text, str) else text
    # Most texts lack the sign or the digits a pattern needs, and are not searched further.
    for pattern, tag, hint in ((EMAIL, "[EMAIL]", out.contains("@")), (CARD, "[CARD]", out.rlike("[0-9]{4}")), (PHONE, "[PHONE]", out.rlike("[0-9]{3}"))):
        out = F.when(hint, F.regexp_replace(out, pattern, tag)).otherwise(out)
    return out


def redaction_filter(order: int = 0) -> ResponseFilter:
    return ResponseFilter(order, rewrite=redact)
