"""From questions to answers: checks, routing, context, rounds, one text per question.

Whatever a language model would do comes in as functions from DataFrame to
DataFrame; a round is one job over all questions that are still open.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from guardedlake.functions.text import is_blank, quality_score
from guardedlake.operators import policy, refine, retrieve, route, sessions
from guardedlake.session import materialise

RESULT = ["request_id", "response", "iterations", "agents_used", "quality_score", "status", "confidence", "reasoning"]


class Round(NamedTuple):
    """The user's functions.

    ``act(calls, n)`` adds ``success, response, error, elapsed_ms`` to one row per
    request and agent, which holds the last ``plan``, the ``summary`` of what was
    observed before and the session's ``history``. ``plan(open, n)`` adds ``plan`` to
    open requests. ``score(open, n)`` adds ``score_text``, and sees a summary that
    holds this round's observations too.
    """

    act: Callable[[DataFrame, int], DataFrame]
    score: Callable[[DataFrame, int], DataFrame]
    plan: Callable[[DataFrame, int], DataFrame] | None = None


def contexts(questions: DataFrame, chunks: DataFrame, template: str, full_text: str, k: int = 8) -> DataFrame:
    """``(request_id, prompt)`` from ``questions(request_id, namespace, embedding)``."""
    asked = questions.withColumnRenamed("request_id", "query_id")
    hits = retrieve.cosine_topk(asked, retrieve.without_kinds(chunks), k)
    found = retrieve.with_fallback(retrieve.assemble(hits, chunks, asked), full_text)
    return found.select(F.col("query_id").alias("request_id"), retrieve.fill_prompt(template, "context").alias("prompt"))


def rounds(open_rows: DataFrame, calls: DataFrame, user: Round, threshold: float = 0.7, max_rounds: int = 5,
           timeout_s: int = 30) -> tuple[DataFrame, DataFrame]:
    """Run the open requests until each is complete, good enough, or out of rounds.

    Gives ``(request_id, iterations, quality_score)`` and the run log. What a round
    adds to either is written to the shared folder before the next one reads it.
    """
    log, ended = [], []
    text = F.lit(None).cast("string")
    state = open_rows.withColumns({"quality_score": F.lit(0.0), "has_text": F.lit(False), "summary": text, "plan": text})
    kept = state.columns
    for n in range(1, max_rounds + 1):
        if n > 1 and user.plan is not None:
            planned = user.plan(state.drop("plan"), n).withColumn("iteration", F.lit(n))
            planned = materialise(planned.withColumn("complete", refine.is_complete("plan")).select(*kept, "complete"), "planned")
            ended.append(planned.where("complete").select("request_id", F.lit(n).alias("iterations"), "quality_score"))
            state = planned.where("NOT complete").select(*kept)
        acted = user.act(state.join(calls, "request_id"), n).withColumn("iteration", F.lit(n))
        acted = refine.apply_timeout(acted, timeout_s).select("request_id", "iteration", "pos", "agent", "success", "response", "error")
        log.append(materialise(acted, "run-log"))
        # The summary runs along: each round appends its own lines and reads no earlier round again.
        lines = refine.observation_summary(log[-1]).withColumnRenamed("summary", "__lines")
        said = log[-1].where("success").where(~is_blank("response")).select("request_id").distinct().withColumn("__said", F.lit(True))
        state = state.join(lines, "request_id", "left").withColumn("summary", F.nullif(F.concat_ws("\n", "summary", "__lines"), F.lit(""))).select(*kept)
        scored = user.score(state, n).join(said, "request_id", "left")
        scored = scored.withColumn("has_text", F.col("has_text") | F.coalesce("__said", F.lit(False)))
        score = F.when(F.col("has_text"), quality_score("score_text")).otherwise(0.0)
        good, still_open = F.col("quality_score") >= threshold, Observation()
        scored = scored.withColumn("quality_score", score).select(*kept).observe(still_open, F.count_if(~good).alias("n"))
        scored = materialise(scored, "scored")
        closed = scored if n == max_rounds else scored.where(good)
        ended.append(closed.select("request_id", F.lit(n).alias("iterations"), "quality_score"))
        state = scored.where(~good)
        if not still_open.get["n"]:
            break
    return reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, log)


def histories(messages: DataFrame, keep: int = 20) -> DataFrame:
    """``(session_key, history)``: the last messages of each session in order, as role and content."""
    last = sessions.trimmed_history(messages, keep).groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("h"))
    return last.select("session_key", F.transform("h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


def exchanges(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The messages that answered requests (with their ``turn``) add to their sessions."""
    keyed = sessions.scoped_keys(requests).select("request_id", "session_key", "query", "turn")
    return sessions.exchange(keyed.join(results.where("status = 'answered'").select("request_id", "response"), "request_id"))


def _agents_used(log: DataFrame) -> DataFrame:
    first = log.where("success").groupBy("request_id", "agent").agg(F.min(F.struct("iteration", "pos")).alias("at"))
    listed = first.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "agent"))).alias("l"))
    return listed.select("request_id", F.col("l.agent").alias("agents_used"))


def answer(requests: DataFrame, agents: list[route.Agent], user: Round, prompts: DataFrame | None = None,
           rules: list[policy.ScopeRule] = [], filters: list[policy.ResponseFilter] = [], replies: DataFrame | None = None,
           threshold: float = 0.7, route_threshold: float = 0.7, max_rounds: int = 5, single_shot: bool = False,
           messages: DataFrame | None = None) -> DataFrame:
    """One result row per request: ``RESULT`` columns.

    ``status`` is ``answered``, or why it was not: ``invalid`` (the violations),
    ``rejected`` (out of scope), or ``error`` (no agent). ``confidence`` and
    ``reasoning`` are those of the route. ``messages`` (session_key, seq, role,
    content) are what was said before; agents get the end of it as ``history``.
    """
    none = F.array().cast("array<string>")
    unrouted = [F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("reasoning")]
    checked = policy.check_scope(sessions.scoped_keys(sessions.validate(requests)), rules)
    invalid = checked.where("NOT valid").select("request_id", F.array_join("violations", "; ").alias("response"), F.lit(0).alias("iterations"),
                                                none.alias("agents_used"), F.lit(0.0).alias("quality_score"), F.lit("invalid").alias("status"), *unrouted)
    usable = checked.where("valid")
    rejected = policy.rejected_results(usable).select("request_id", "response", "iterations", none.alias("agents_used"), "quality_score",
                                                      F.lit("rejected").alias("status"), *unrouted)
    asked = usable.where("in_scope")
    routed = materialise(route.route(asked, agents, replies, threshold=route_threshold).select("request_id", "targets", "confidence", "reasoning"), "routed")
    why = routed.select("request_id", "confidence", "reasoning")
    calls, lost = route.resolve_agents(routed.join(asked.select("request_id", "query"), "request_id"), route.agents_frame(requests.sparkSession, agents))
    # Every round reads the calls; they are resolved once.
    calls, lost = materialise(calls, "calls"), materialise(lost, "lost")
    lost = lost.select("request_id", F.col("error_message").alias("response"), F.lit(0).alias("iterations"), none.alias("agents_used"),
                       F.lit(0.0).alias("quality_score"), F.lit("error").alias("status")).join(why, "request_id")
    open_rows = asked.select("request_id", "session_key", "query").join(calls.select("request_id").distinct(), "request_id", "left_semi")
    if prompts is not None:
        open_rows = open_rows.join(prompts, "request_id", "left")
    if messages is not None:
        open_rows = open_rows.join(histories(messages), "session_key", "left")
    else:
        open_rows = open_rows.withColumn("history", F.array().cast("array<struct<role:string,content:string>>"))
    # Prompts cost a search each; they are made once, before the first round.
    open_rows = materialise(open_rows, "open")
    if single_shot:
        acted = materialise(refine.apply_timeout(user.act(open_rows.join(_first_call(calls), "request_id"), 1)), "run-log")
        done = refine.single_shot(acted.select("request_id", "pos", "agent"), acted)
        done = done.withColumn("agents_used", F.when(F.col("agents_used") == "", none).otherwise(F.array("agents_used")))
    else:
        ended, log = rounds(open_rows, calls, user, threshold, max_rounds)
        done = (ended.join(refine.consolidate(ended, log), "request_id").join(_agents_used(log), "request_id", "left")
                .withColumn("agents_used", F.coalesce("agents_used", none)))
    answered = policy.apply_filters(done, filters).withColumn("status", F.lit("answered")).join(why, "request_id")
    return reduce(DataFrame.unionByName, [answered.select(*RESULT), rejected.select(*RESULT), invalid.select(*RESULT), lost.select(*RESULT)])


def _first_call(calls: DataFrame) -> DataFrame:
    first = calls.groupBy("request_id").agg(F.min_by("agent", "pos").alias("agent"))
    return first.withColumn("pos", F.lit(0))
