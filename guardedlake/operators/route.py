"""Which agent answers a request: keyword scores, model replies, catalog, answer bank."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardedlake.functions.automaton import LETTERS_AT_ONCE, automata
from guardedlake.functions.ordered import latest
from guardedlake.functions.text import tokens


# Reasons a route is given, the confidence of a model's choice, and the error without an agent.
NO_AGENTS = "No agents available"
KEYWORD_MATCH = "Keyword match"
BELOW_THRESHOLD = "Best keyword match (below threshold, no LLM available)"
NO_MATCH = "No matching agents found and no LLM available"
MODEL_CHOICE = "LLM classification"
MODEL_FAILED = "LLM routing failed: no reply"
MODEL_CONFIDENCE = 0.8
NO_TARGET_CODE = "ORCHESTRATION_ERROR"
NO_TARGET = "Routing found no suitable agents for query"
NO_HEALTHY = "No healthy agents available"


class Agent(NamedTuple):
    name: str
    keywords: list[str]
    healthy: bool = True


def agents_frame(spark, agents: list[Agent]) -> DataFrame:
    """The registrations; of a name that is registered twice the last one holds."""
    last = {a.name: i for i, a in enumerate(agents)}
    rows = [(i, agents[i].name, list(agents[i].keywords), agents[i].healthy) for i in sorted(last.values())]
    return spark.createDataFrame(rows, "pos int, agent string, keywords array<string>, healthy boolean")


def keyword_scores(requests: DataFrame, agents: list[Agent] | DataFrame, text: str = "query") -> DataFrame:
    """``(request_id, agent, score)`` for scores above 0.

    The score is the share of a request's distinct words that are keywords. Words are
    joined with keywords, so that any number of agents may be registered; hits are
    counted in each task before they are shuffled.
    """
    known = agents if isinstance(agents, DataFrame) else agents_frame(requests.sparkSession, agents)
    words = requests.select("request_id", tokens(text).alias("w"))
    words = words.select("request_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    keys = known.select("agent", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("word"))
    return words.join(keys, "word").groupBy("request_id", "agent").agg((F.count(F.lit(1)) / F.first("n")).alias("score"))


def route(requests: DataFrame, agents: list[Agent], replies: DataFrame | None = None, text: str = "query",
          threshold: float = 0.7) -> DataFrame:
    """``(request_id, targets, confidence, reasoning, fallback)``, one row per request.

    All agents at or above the threshold, best first; else what a model's reply
    names, if replies ``(request_id, reply)`` are given; else the best agent below
    the threshold, marked as a fallback; else none. Only healthy agents count.
    """
    usable = [a for a in {a.name: a for a in agents}.values() if a.healthy]
    if not usable:
        none = F.array().cast("array<string>")
        return requests.select("request_id", none.alias("targets"), F.lit(0.0).alias("confidence"),
                               F.lit(NO_AGENTS).alias("reasoning"), F.lit(False).alias("fallback"))
    scored = keyword_scores(requests, usable, text)
    grouped = scored.groupBy("request_id").agg(F.collect_list(F.struct("agent", "score")).alias("s"))
    base = requests.select("request_id").join(grouped, "request_id", "left").withColumn(
        "s", F.coalesce("s", F.array().cast("array<struct<agent:string,score:double>>")))
    # Best first, equal scores by name.
    best_first = F.array_sort(F.transform("s", lambda x: F.struct((-x["score"]).alias("neg"), x["agent"].alias("agent"))))
    base = base.select("request_id", best_first.alias("s"))
    sure = F.filter("s", lambda x: -x["neg"] >= threshold)
    base = base.select("request_id", F.transform(sure, lambda x: x["agent"]).alias("sure"),
                       F.get("s", F.lit(0))["agent"].alias("best"),
                       F.coalesce(-F.get("s", F.lit(0))["neg"], F.lit(0.0)).alias("score"))
    matched = F.size("sure") > 0
    if replies is not None:
        parsed = parse_replies(replies, [a.name for a in usable])
        joined = base.join(parsed, "request_id", "left")
        none = F.array().cast("array<string>")
        return joined.select(
            "request_id", F.when(matched, F.col("sure")).otherwise(F.coalesce("agents", none)).alias("targets"),
            F.when(matched, F.col("score")).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
            F.when(matched, KEYWORD_MATCH).otherwise(F.coalesce("reasoning", F.lit(MODEL_FAILED))).alias("reasoning"),
            (~matched & F.coalesce("failed", F.lit(True))).alias("fallback"))
    some = F.col("best").isNotNull()
    return base.select(
        "request_id", F.when(matched, F.col("sure")).when(some, F.array("best")).otherwise(F.array().cast("array<string>")).alias("targets"),
        F.col("score").alias("confidence"),
        F.when(matched, KEYWORD_MATCH).when(some, BELOW_THRESHOLD)
        .otherwise(NO_MATCH).alias("reasoning"),
        (~matched).alias("fallback"))


# How a reply names agents and gives its reason.
REPLY_AGENTS = r'"agents"\s*:\s*\[([^\]]*)\]'
REPLY_REASON = r'"reasoning"\s*:\s*"([^"]+)"'


def parse_replies(replies: DataFrame, known: list[str] | DataFrame) -> DataFrame:
    """Names and reasoning out of ``(request_id, reply)``, one row per request; unknown names are dropped.

    A null reply stands for a failed call. Of several replies to one request the one
    with the highest ``seq`` counts, where there is such a column; else the greatest text.
    """
    names = known.select("agent").distinct() if isinstance(known, DataFrame) else replies.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(known)], "agent string")
    order = [c for c in ("seq",) if c in replies.columns]
    one = replies.groupBy("request_id").agg(F.max(F.struct(*order, F.col("reply").isNotNull().alias("given"), "reply"))["reply"].alias("reply"))
    text = F.coalesce("reply", F.lit(""))
    said = one.select("request_id", "reply", F.regexp_extract_all(F.regexp_extract(text, REPLY_AGENTS, 1), F.lit('"([^"]+)"'), 1).alias("said"),
                      F.regexp_extract(text, REPLY_REASON, 1).alias("why"))
    found = said.select("request_id", F.posexplode("said").alias("pos", "agent")).join(names, "agent")
    found = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "agent")))["agent"].alias("agents"))
    failed = F.col("reply").isNull()
    return said.join(found, "request_id", "left").withColumn("agents", F.coalesce("agents", F.array().cast("array<string>"))).select(
        "request_id", "agents", F.when(F.size("agents") > 0, MODEL_CONFIDENCE).otherwise(0.0).alias("confidence"),
        F.when(failed, MODEL_FAILED).when(F.col("why") == "", MODEL_CHOICE).otherwise(F.col("why")).alias("reasoning"), failed.alias("failed"))


def resolve_agents(routes: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routed names that exist and are healthy, and the requests left with none.

    ``routes(request_id, targets)``, ``agents(agent, healthy)``; the first result is
    ``(request_id, pos, agent)`` in routed order, the second carries the error. With
    ``query`` and ``reasoning`` in ``routes`` the error names the question, or says
    that no agent was healthy.
    """
    text = F.concat(F.lit(f"{NO_TARGET}: "), "query") if "query" in routes.columns else F.lit(NO_TARGET)
    if "reasoning" in routes.columns:
        text = F.when(F.col("reasoning") == NO_AGENTS, NO_HEALTHY).otherwise(text)
    wanted = routes.select("request_id", F.posexplode("targets").alias("pos", "agent"))
    found = wanted.join(agents.where("healthy").select("agent").distinct(), "agent").select("request_id", "pos", "agent")
    lost = (routes.withColumn("error_message", text).join(found.select("request_id"), "request_id", "left_anti")
            .select("request_id", F.lit(NO_TARGET_CODE).alias("error_code"), "error_message"))
    return found, lost


def registered_agents(registrations: DataFrame, order: str = "pos") -> DataFrame:
    """The last registration of each name."""
    return latest(registrations, ["agent"], [order])


def agent_markdown(agents: DataFrame) -> DataFrame:
    """``(agent, markdown)``: description, capabilities and keywords of each agent.

    ``agents(agent, description, capabilities array<struct<name, description>>,
    keywords array<string>)``; lists come out in name order.
    """
    caps = F.transform(F.array_sort("capabilities"), lambda c: F.concat(
        F.lit("- **"), c["name"], F.lit("**: "), c["description"], F.lit("\n")))
    cap_text = F.when(F.size("capabilities") > 0, F.concat(F.lit("**Capabilities:**\n"), F.array_join(caps, ""), F.lit("\n"))).otherwise("")
    key_text = F.when(F.size("keywords") > 0, F.concat(
        F.lit("**Keywords:** "), F.array_join(F.array_sort("keywords"), ", "), F.lit("\n\n"))).otherwise("")
    return agents.select("agent", F.concat(
        F.lit("## "), "agent", F.lit("\n**Description:** "), "description", F.lit("\n\n"), cap_text, key_text).alias("markdown"))


def agents_document(agents: DataFrame) -> DataFrame:
    """One document over the registered agents, a catalog of configured size."""
    parts = agent_markdown(agents).agg(F.array_sort(F.collect_list(F.struct("agent", "markdown"))).alias("p"))
    return parts.select(F.when(F.size("p") == 0, "No agents registered.").otherwise(
        F.concat(F.lit("# Registered Sub-Agents\n\n"), F.array_join("p.markdown", ""))).alias("document"))


class BankEntry(NamedTuple):
    phrases: list[str]
    response: str


def _bank_scores(phrases: list[str], owner: np.ndarray, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best entry of each text by the phrases found in it, the earlier on ties."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = list(automata(phrases))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best, score = np.zeros(len(texts), dtype=np.int32), np.zeros(len(texts), dtype=np.int32)
            for at, part in _some(texts):
                found = [(row, owner[first + phrase]) for first, machine in machines for row, phrase in [machine.found(part)]]
                key = np.concatenate([row * entries + entry for row, entry in found]) if found else np.zeros(0, dtype=np.int64)
                key, n = np.unique(key, return_counts=True)
                row, entry = np.divmod(key, max(entries, 1))
                order = np.lexsort((entry, -n, row))
                first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
                best[at + row[first]], score[at + row[first]] = entry[first], n[first]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(score > 0, best, -1).astype(np.int32)), pa.array(score)], ["request_id", "entry", "score"])

    return task


def _some(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Some texts at a time, with the place of the first."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= LETTERS_AT_ONCE or i + 1 == len(texts):
            yield first, texts[first:i + 1]
            first, held = i + 1, 0


def bank_lookup(requests: DataFrame, bank: list[BankEntry], refusal: str, text: str = "query", least: int = 2) -> DataFrame:
    """``(request_id, entry, score, success, response)`` from recorded answers.

    An entry scores one for each of its phrases the question contains; the highest
    score wins, the earlier entry on ties, and a score below ``least`` is refused.

    All phrases are looked for in one walk over each question, linear in its length;
    nothing is shuffled. Answers are joined to the entries that won.
    """
    spark = requests.sparkSession
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    rows = [(i, p) for i, e in enumerate(bank) for p in sorted(set(e.phrases))]
    kept = T.StructType([T.StructField("request_id", requests.schema["request_id"].dataType), T.StructField("entry", T.IntegerType()), T.StructField("score", T.IntegerType())])
    scored = requests.select("request_id", clean.alias("q")).mapInArrow(_bank_scores([p for _, p in rows], np.array([i for i, _ in rows], dtype=np.int64), len(bank)), kept)
    answers = spark.createDataFrame([(i, e.response) for i, e in enumerate(bank)], "entry int, answer string")
    good = F.col("score") >= least
    return scored.join(answers, "entry", "left").select("request_id", F.when(good, F.col("entry")).otherwise(-1).alias("entry"), "score", good.alias("success"),
                                                        F.when(good, F.col("answer")).otherwise(F.lit(refusal)).alias("response"))
