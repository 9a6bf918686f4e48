"""Counters and distributions over a run log, and the health row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency_summary(queries: DataFrame, by: list[str], latency: str = "latency_ms",
                    quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, total, mean, maximum and exact quantiles of whole-millisecond latencies.

    Rows are first counted per distinct latency, map-side. A quantile is the least
    latency with enough rows at or below it; the window that finds it sees at most
    one row per distinct millisecond, which the response time limit bounds.
    """
    counts = queries.groupBy(*by, F.col(latency).alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    run = counts.withColumn("cum", F.sum("n").over(group.orderBy("ms"))).withColumn("all", F.sum("n").over(group))
    return run.groupBy(*by).agg(
        F.sum("n").alias("query_count"), F.sum(F.col("ms") * F.col("n")).alias("total_ms"),
        (F.sum(F.col("ms") * F.col("n")) / F.sum("n")).alias("mean_ms"), F.max("ms").alias("max_ms"),
        *[F.min(F.when(F.col("cum") >= F.ceil(F.col("all") * F.lit(p)), F.col("ms"))).alias(f"p{round(p * 100)}_ms")
          for p in quantiles])


def approximate_latency(queries: DataFrame, by: list[Column | str], latency: str = "latency_ms") -> DataFrame:
    """The one-pass form for values without a bound, and for streams."""
    return queries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("query_count"), F.avg(latency).alias("mean_ms"), F.max(latency).alias("max_ms"),
        F.percentile_approx(latency, [0.5, 0.95, 0.99]).alias("quantiles_ms"))


SKETCH_K = 400  # items a quantile sketch keeps per level
RANK_ERROR = 0.02  # several times what a sketch of that size shows in 99 of 100 cases


def latency_sketches(queries: DataFrame, by: list[str | Column], latency: str = "latency_ms") -> DataFrame:
    """Count, total, maximum and a quantile sketch per group: what ``merge_sketches`` adds up.

    A sketch has a bounded size whatever it has seen and is built map-side, so a busy
    group sends one per task. Up to ``SKETCH_K`` rows it is exact; beyond, the rank of a
    quantile is off by less than ``RANK_ERROR``. Null latencies count as queries only.
    """
    return queries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("query_count"), F.sum(latency).alias("total_ms"), F.max(latency).alias("max_ms"),
        F.kll_sketch_agg_bigint(latency, F.lit(SKETCH_K)).alias("sketch"))


def merge_sketches(stored: DataFrame, by: list[str | Column]) -> DataFrame:
    """Stored groups merged to coarser ones, without a look at the rows behind them."""
    return stored.groupBy(*by).agg(
        F.sum("query_count").alias("query_count"), F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("sketch"))


def sketched_quantiles(stored: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Stored groups with their quantiles as ``p50_ms`` and so on; null where no latency was seen."""
    read = {f"p{round(p * 100)}_ms": F.when(F.col("max_ms").isNotNull(), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p))) for p in quantiles}
    return stored.withColumns(read).drop("sketch")


def sliding_panes(panes: DataFrame, by: list[str], width_s: int, slide_s: int) -> DataFrame:
    """Sliding windows merged from panes ``(pane_start, by, ...)`` that are ``slide_s`` long.

    A pane goes to the ``width_s / slide_s`` windows that hold it; the rows it stands for
    were read once.
    """
    if width_s % slide_s:
        raise ValueError("a window has to be a whole number of panes")
    back = F.explode(F.sequence(F.lit(0), F.lit(width_s - slide_s), F.lit(slide_s)))
    spread = panes.select("*", back.alias("__back")).withColumn("window_start", F.col("pane_start") - F.make_dt_interval(secs=F.col("__back")))
    return merge_sketches(spread, ["window_start", *by])


def rank_errors(quantiles: DataFrame, rows: DataFrame, by: list[str], latency: str = "latency_ms", which: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``(by, rank_error)``: how far the worst of the given quantiles is from its rank among the rows.

    Rows are counted per distinct latency before they meet the quantiles.
    """
    names = [f"p{round(p * 100)}_ms" for p in which]
    counts = rows.where(F.col(latency).isNotNull()).groupBy(*by, F.col(latency).alias("__ms")).agg(F.count(F.lit(1)).alias("__n"))
    met = counts.join(quantiles.select(*by, *names), by)
    sums = [e for q in names for e in (F.sum(F.when(F.col("__ms") < F.col(q), F.col("__n")).otherwise(0)).alias(f"{q}_below"),
                                       F.sum(F.when(F.col("__ms") <= F.col(q), F.col("__n")).otherwise(0)).alias(f"{q}_upto"))]
    ranks = met.groupBy(*by).agg(F.sum("__n").alias("__all"), *sums)
    off = [F.greatest(F.lit(0.0), F.col(f"{q}_below") / F.col("__all") - F.lit(p), F.lit(p) - F.col(f"{q}_upto") / F.col("__all")) for p, q in zip(which, names)]
    return ranks.select(*by, F.greatest(*off).alias("rank_error"))


def iteration_summary(results: DataFrame, by: list[str] = []) -> DataFrame:
    """Rounds per query, over those that succeeded."""
    ok = results.where("success")
    return (ok.groupBy(*by) if by else ok).agg(
        F.count(F.lit(1)).alias("n"), F.sum("iterations").alias("total"), F.max("iterations").alias("most"),
        F.avg("iterations").alias("mean"))


def agent_calls(log: DataFrame) -> DataFrame:
    """Calls by agent and outcome, failures included."""
    return log.groupBy("agent", "success").agg(F.count(F.lit(1)).alias("calls"))


def agent_outcomes(log: DataFrame) -> DataFrame:
    """The same as one row per agent."""
    return log.groupBy("agent").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def health(agents: DataFrame, active: DataFrame) -> DataFrame:
    """One row: UP if a healthy agent exists, with the counts.

    ``active`` is the one-row result of ``sessions.active_count``.
    """
    counts = agents.agg(F.count_if("healthy").alias("healthy_agents"), F.count(F.lit(1)).alias("agents"))
    both = counts.unionByName(active, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("agents", "healthy_agents", "active_sessions")])
    return (both.select(F.when(F.col("healthy_agents") > 0, "UP").otherwise("DOWN").alias("status"),
                    "agents", "healthy_agents", "active_sessions"))
