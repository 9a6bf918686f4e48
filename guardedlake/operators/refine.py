"""Rounds of answering: the refinement loop, its replay from a log, and consolidation.

A run log is ``(request_id, iteration, pos, agent, plan, success, response, error,
score_text, elapsed_ms)``, one row per agent call; the plan and the score repeat on
the rows of a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from guardedlake.functions.ordered import ordered_text, top_per_key
from guardedlake.functions.text import is_blank, quality_score, strip
from guardedlake.session import materialise

# Texts of failed calls and of answers that are put together.
TIMED_OUT = "Agent timed out after {}s"
FAILED = "Agent execution failed: "
NOT_CALLED = "No response from agent"
NO_TEXT = "(no text)"
NO_RESPONSES = "No responses were generated for your query."
ALL_FAILED = "All agents failed to process your query:\n"
BETWEEN_ANSWERS = "\n\n---\n\n"

Step = Callable[[DataFrame, int], DataFrame]


def refine(requests: DataFrame, step: Step, score: Callable[[DataFrame], DataFrame], threshold: float = 0.7,
           max_rounds: int = 5) -> DataFrame:
    """Answer open requests round by round until each is good enough.

    ``step`` adds ``response`` to the open requests, which hold the ``last_response``
    and ``last_score`` of the round before; ``score`` adds ``quality_score``.
    All open requests of a round are one job; its rows are written to the shared
    folder and counted while they are, so a later round starts from files instead of from all earlier ones, and
    a lost executor loses at most its own tasks.
    """
    kept = [c for c in requests.columns]
    open_rows = requests.withColumns({"last_response": F.lit(None).cast("string"), "last_score": F.lit(None).cast("double")})
    done = None
    for n in range(1, max_rounds + 1):
        scored = score(step(open_rows, n)).withColumn("iterations", F.lit(n))
        good = F.coalesce(F.col("quality_score") >= threshold, F.lit(False))
        still_open = Observation()
        scored = scored.select(*kept, "response", "quality_score", "iterations").observe(still_open, F.count_if(~good).alias("n"))
        scored = materialise(scored, "refine-round")
        closed = scored if n == max_rounds else scored.where(good)
        done = closed if done is None else done.unionByName(closed)
        open_rows = scored.where(~good).select(*kept, F.col("response").alias("last_response"), F.col("quality_score").alias("last_score"))
        if not still_open.get["n"]:
            break
    return done


def is_complete(plan: Column | str) -> Column:
    """A plan that says nothing is missing; a failed planner (null) says so too.

    The first round never asks the planner, so it is not complete whatever it holds.
    """
    c = F.col(plan) if isinstance(plan, str) else plan
    return (F.col("iteration") > 1) & F.coalesce(F.upper(strip(c)) == "COMPLETE", F.lit(True))


def replay(log: DataFrame, threshold: float = 0.7, max_rounds: int = 5) -> DataFrame:
    """What the loop made of each request, computed from a log of all possible rounds.

    Gives ``(request_id, iterations, stopped_by, quality_score, agents_used)``. A
    round that plans COMPLETE counts but adds nothing; a round without any
    successful text so far scores 0; otherwise the logged score text is parsed.

    Calls are first reduced to one row per request, round and agent, map-side, so
    the list a request then becomes is bounded by rounds and registered agents.
    """
    calls = log.where(F.col("iteration").between(1, max_rounds)).groupBy("request_id", "iteration", "agent").agg(
        F.min(F.when(F.col("success"), F.col("pos"))).alias("pos"),
        F.bool_or(is_complete("plan")).alias("complete"),
        F.bool_or(F.col("success") & ~is_blank("response")).alias("text"),
        F.max("score_text").alias("score_text"))
    lists = calls.groupBy("request_id").agg(F.collect_list(F.struct("iteration", "pos", "agent", "complete", "text", "score_text")).alias("c"))

    def of_round(n: Column) -> Column:
        mine = F.filter("c", lambda x: x["iteration"] == n)
        said = F.exists("c", lambda x: (x["iteration"] <= n) & x["text"])
        score = F.when(said, quality_score(F.array_max(F.transform(mine, lambda x: x["score_text"])))).otherwise(0.0)
        return F.struct(n.alias("n"), F.exists(mine, lambda x: x["complete"]).alias("complete"), score.alias("score"))

    numbers = F.array_sort(F.array_distinct(F.transform("c", lambda x: x["iteration"])))
    rounds = lists.withColumn("r", F.transform(numbers, of_round))
    ended = F.filter("r", lambda x: x["complete"] | (x["score"] >= threshold))
    stop = F.coalesce(F.get(ended, F.lit(0)), F.get("r", F.size("r") - 1))
    by = F.when(F.col("stop.complete"), "complete").when(F.col("stop.score") >= threshold, "threshold").otherwise("max")
    # Rounds that ran an agent: up to the stop, without one that only planned.
    ran = F.filter("r", lambda x: (x["n"] <= F.col("stop.n")) & ~x["complete"])
    used = F.filter("c", lambda x: (x["iteration"] <= F.col("stop.n")) & ~(F.col("stop.complete") & (x["iteration"] == F.col("stop.n"))) & x["pos"].isNotNull())
    seen = F.array_sort(F.transform(used, lambda x: F.struct(x["iteration"].alias("i"), x["pos"].alias("p"), x["agent"].alias("a"))))
    return rounds.withColumn("stop", stop).select(
        "request_id", F.col("stop.n").alias("iterations"), by.alias("stopped_by"),
        F.when(F.size(ran) > 0, F.get(ran, F.size(ran) - 1)["score"]).otherwise(0.0).alias("quality_score"),
        F.array_distinct(F.transform(seen, lambda x: x["a"])).alias("agents_used"))


def single_shot(routed: DataFrame, responses: DataFrame) -> DataFrame:
    """The first routed agent's answer, or its error text; one round, score 1.

    ``routed(request_id, pos, agent)``, ``responses(request_id, agent, success,
    response, error)``.
    """
    first = top_per_key(routed, ["request_id"], [F.col("pos")], 1, "n").drop("n", "pos")
    joined = first.join(responses, ["request_id", "agent"], "left")
    ok = F.coalesce("success", F.lit(False))
    return joined.select(
        "request_id", F.when(ok, F.col("response")).otherwise(F.coalesce("error", F.lit(NOT_CALLED))).alias("response"),
        F.when(ok, F.col("agent")).otherwise("").alias("agents_used"), F.lit(1).alias("iterations"), F.lit(1.0).alias("quality_score"))


def apply_timeout(log: DataFrame, limit_s: int = 30) -> DataFrame:
    """Calls slower than the limit become failures; other failures get their prefix."""
    late = F.col("elapsed_ms") > limit_s * 1000
    failed = ~F.col("success") & ~late
    return (log.withColumn("error", F.when(late, TIMED_OUT.format(limit_s))
                           .when(failed, F.concat(F.lit(FAILED), F.coalesce("error", F.lit("null"))))
                           .otherwise(F.col("error")))
            .withColumn("response", F.when(late, None).otherwise(F.col("response")))
            .withColumn("success", F.col("success") & ~late))


def consolidate(requests: DataFrame, log: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``(request_id, response)``: one text from all answers of a request.

    One success passes through; several give the text of a model if ``merged
    (request_id, merged)`` has one, else the answers under their agents' names;
    none gives the list of errors. Texts are joined in two steps, first by round,
    and the counts come from the same two steps.
    """
    ok = F.col("success")
    # An answer without text is still an answer, and is shown as such.
    log = log.withColumn("response", F.when(ok, F.coalesce("response", F.lit(NO_TEXT))).otherwise(F.col("response")))
    good = F.concat(F.lit("**"), "agent", F.lit(":**\n"), "response")
    bad = F.concat(F.lit("- "), "agent", F.lit(": "), F.coalesce("error", F.lit("null")))

    def joined(entries: Column, sep: str) -> Column:
        return F.array_join(F.transform(F.array_sort(entries), lambda e: e["t"]), sep)

    def listed(order: Column, text: Column) -> Column:
        return F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t"))))

    per_round = log.groupBy("request_id", "iteration").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_good"), F.min_by("response", F.when(ok, F.col("pos"))).alias("only"),
        joined(listed(F.col("pos"), F.when(ok, good)), BETWEEN_ANSWERS).alias("good"), joined(listed(F.col("pos"), F.when(~ok, bad)), "\n").alias("bad"))
    some = F.col("n_good") > 0
    counts = per_round.groupBy("request_id").agg(
        F.sum("n").alias("n"), F.sum("n_good").alias("n_good"), F.min_by("only", F.when(some, F.col("iteration"))).alias("only"),
        joined(listed(F.col("iteration"), F.when(some, F.col("good"))), BETWEEN_ANSWERS).alias("good_text"),
        joined(listed(F.col("iteration"), F.when(F.col("n_good") < F.col("n"), F.col("bad"))), "\n").alias("bad_text"))
    out = requests.select("request_id").join(counts, "request_id", "left")
    text = F.col("good_text")
    if merged is not None:
        out = out.join(merged.select("request_id", "merged"), "request_id", "left")
        text = F.coalesce("merged", "good_text")
    return out.select("request_id", F.when(F.col("n").isNull(), NO_RESPONSES)
                      .when(F.col("n_good") == 0, F.concat(F.lit(ALL_FAILED), "bad_text"))
                      .when(F.col("n_good") == 1, F.col("only")).otherwise(text).alias("response"))


def observation_summary(log: DataFrame) -> DataFrame:
    """``(request_id, summary)``: ``[agent]: response`` lines of the successes, by round and place."""
    line = F.concat(F.lit("["), "agent", F.lit("]: "), "response").alias("line")
    calls = log.where("success").select("request_id", F.col("iteration").cast("long").alias("iteration"), F.col("pos").cast("long").alias("pos"), line)
    rounds = ordered_text(calls, ["request_id", "iteration"], "pos", "line", "lines", "\n")
    return ordered_text(rounds, ["request_id"], "iteration", "lines", "summary", "\n")
