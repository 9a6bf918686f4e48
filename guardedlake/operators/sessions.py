"""Requests and sessions as tables: validation, keys, history, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardedlake.functions.ordered import top_per_key
from guardedlake.functions.text import is_blank, label

# What a request is refused with.
BLANK_QUERY = "Query must not be blank"
LONG_QUERY = "Query must not exceed 10,000 characters"
LONG_SESSION = "Session ID must not exceed 100 characters"


def validate(requests: DataFrame) -> DataFrame:
    """Add ``violations`` (all that apply) and ``valid``; null options become an empty map."""
    found = F.array_compact(F.array(
        F.when(is_blank("query"), BLANK_QUERY),
        F.when(F.length("query") > 10_000, LONG_QUERY),
        F.when(F.length("session_id") > 100, LONG_SESSION)))
    out = requests.withColumn("violations", found).withColumn("valid", F.size("violations") == 0)
    if "options" in requests.columns:
        out = out.withColumn("options", F.coalesce("options", F.create_map().cast("map<string,string>")))
    return out


def scoped_keys(requests: DataFrame) -> DataFrame:
    """Add ``session_key`` (tenant and session), with defaults for what is missing.

    A new session id is a digest of the request id, so a re-run names it the same.
    """
    new_id = F.sha2(F.col("request_id").cast("string"), 256)
    session = F.when(is_blank("session_id"), new_id).otherwise(F.col("session_id"))
    return (requests.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("default")))
            .withColumn("user_id", F.coalesce("user_id", F.lit("anonymous")))
            .withColumn("session_id", session)
            .withColumn("session_key", F.concat_ws(":", "tenant_id", "session_id")))


def exchange(answered: DataFrame, turn: str = "turn") -> DataFrame:
    """Two messages per answered request: the question, then the answer."""
    pair = F.array(F.struct((F.col(turn) * 2).alias("seq"), F.lit("USER").alias("role"), F.col("query").alias("content")),
                   F.struct((F.col(turn) * 2 + 1).alias("seq"), F.lit("ASSISTANT").alias("role"), F.col("response").alias("content")))
    return answered.select("session_key", F.inline(pair))


def trimmed_history(messages: DataFrame, keep: int = 20) -> DataFrame:
    """The last ``keep`` messages of each session.

    Ranking and filter together are cut to ``keep`` rows per session in every map
    task, so a session with a third of all messages is not moved as a whole.
    """
    return top_per_key(messages, ["session_key"], [F.col("seq").desc()], keep, "__n").drop("__n")


def merge_writers(*appends: DataFrame, keep: int = 20) -> DataFrame:
    """Messages of concurrent writers, none lost, then trimmed."""
    out = appends[0]
    for more in appends[1:]:
        out = out.unionByName(more)
    return trimmed_history(out, keep)


def summaries(messages: DataFrame) -> DataFrame:
    """First question, its label, last access and message count of each session."""
    asked = F.when(F.upper("role") == "USER", F.col("seq"))
    return (messages.groupBy("session_key")
            .agg(F.min_by("content", asked).alias("first_query"), F.max("seq").alias("last_seq"),
                 F.count(F.lit(1)).alias("message_count"))
            .withColumn("label", label("first_query")))


def idle_sessions(accesses: DataFrame, key: str = "session_key", ts: str = "ts", idle_minutes: int = 30) -> DataFrame:
    """``(key, session_no, started, last_access, n)``: runs of accesses without an idle gap.

    Accesses within one slot of the idle length cannot be in different sessions, so
    they are first reduced to one row per key and slot, map-side. What the window
    then sees of a key is bounded by elapsed time, however many accesses it has.
    """
    gap = idle_minutes * 60
    second = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = (accesses.select(key, second.alias("us"), F.floor(second / (gap * 1_000_000)).alias("slot"))
             .groupBy(key, "slot").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n")))
    by_slot = Window.partitionBy(key).orderBy("slot")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(by_slot) >= gap * 1_000_000, F.lit(True))
    numbered = slots.withColumn("s", starts.cast("int")).withColumn("session_no", F.sum("s").over(by_slot))
    return (numbered.groupBy(key, "session_no")
            .agg(F.timestamp_micros(F.min("lo")).alias("started"), F.timestamp_micros(F.max("hi")).alias("last_access"),
                 F.sum("n").alias("n")))


def live_at(accesses: DataFrame, as_of: Column, key: str = "session_key", ts: str = "ts", idle_minutes: int = 30) -> DataFrame:
    """Keys whose last access up to ``as_of`` is within the idle limit of it."""
    seen = accesses.where(F.col(ts).cast("timestamp") <= as_of)
    last = seen.groupBy(key).agg(F.max(F.col(ts).cast("timestamp")).alias("last_access"))
    return last.where(F.col("last_access") > as_of - F.make_dt_interval(mins=F.lit(idle_minutes)))


def cap_sessions(last_access: DataFrame, limit: int = 1000, key: str = "session_key") -> DataFrame:
    """The ``limit`` most recently used sessions: a top-k, not a sort of all."""
    return last_access.orderBy(F.col("last_access").desc(), F.col(key).asc()).limit(limit)


def get_sessions(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """Messages of the asked keys."""
    return messages.join(keys.select("session_key").distinct(), "session_key", "left_semi")


def delete_sessions(messages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Messages without those of deleted keys."""
    return messages.join(deleted.select("session_key").distinct(), "session_key", "left_anti")


def active_count(messages: DataFrame) -> DataFrame:
    """Number of sessions that hold a message; two-step, so it is spread over keys."""
    return messages.select("session_key").distinct().agg(F.count(F.lit(1)).alias("active_sessions"))


ACTIVE_BITS = 14  # a sketch has 2 ** 14 registers, and keeps short lists of keys as they are
ACTIVE_ERROR = 0.05  # six standard errors of such a sketch


def active_sketches(accesses: DataFrame, by: list[str | Column], key: str = "session_key") -> DataFrame:
    """``(by, active)``: a sketch of the distinct keys of each group, to be stored.

    Built map-side and of bounded size, so neither keys nor accesses are shuffled. Null
    keys are nobody's and don't count.
    """
    return accesses.groupBy(*by).agg(F.hll_sketch_agg(key, F.lit(ACTIVE_BITS)).alias("active"))


def merged_active(stored: DataFrame, by: list[str | Column]) -> DataFrame:
    """``(by, active_sessions)`` of stored sketches: a key that several of them hold counts once.

    The number is off by less than ``ACTIVE_ERROR`` of itself. Storing a period twice
    changes nothing, so a batch that is written again after a failure does no harm.
    """
    return stored.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("active")).alias("active_sessions"))
