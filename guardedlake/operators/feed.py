"""Progress feeds: event lines to events, events to messages and step states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardedlake.functions.ordered import ordered_text, running_total


def parse_events(lines: DataFrame, keys: list[str] = ["file"], span: int = 100_000) -> DataFrame:
    """``(keys, event_no, type, payload)`` from ``(keys, line_no, line)``.

    A blank line closes an event. The block of a line is the number of blank lines
    before it, a two-level running count, so one long file is many tasks. The last
    ``event:`` and ``data:`` line of a block count; a block without both is dropped,
    and so is one that no blank line closes.
    """
    blank = (F.col("line") == "").cast("int")
    counted = running_total(lines, keys, "line_no", blank, "seen", span)
    block = F.col("seen") - blank

    def field(prefix: str):
        value = F.when(F.col("line").startswith(prefix), F.btrim(F.substring("line", len(prefix) + 1, 2_000_000_000)))
        return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))

    return (counted.groupBy(*keys, block.alias("block"))
            .agg(field("event:").alias("type"), field("data:").alias("payload"), F.bool_or(blank == 1).alias("closed"),
                 F.min("line_no").alias("event_no"))
            .where("closed AND type <> '' AND payload <> ''")
            .select(*keys, "event_no", "type", "payload"))


def reduce_messages(events: DataFrame, keys: list[str] = ["message_id"]) -> DataFrame:
    """``(keys, content, complete)`` from ``(keys, seq, type, text)``.

    ``data`` texts are joined in order; an ``error`` replaces what came before it by
    ``Error: text``; ``done`` completes. Only chunks after the last error are joined,
    in two steps, so a long answer is not gathered row by row in one task.
    """
    is_error = F.col("type") == "error"
    state = events.groupBy(*keys).agg(
        F.max(F.when(is_error, F.col("seq"))).alias("error_seq"),
        F.max_by("text", F.when(is_error, F.col("seq"))).alias("error_text"),
        F.bool_or(F.col("type") == "done").alias("complete"))
    chunks = events.where("type = 'data'").join(state.select(*keys, "error_seq"), keys).where(
        F.col("error_seq").isNull() | (F.col("seq") > F.col("error_seq")))
    body = ordered_text(chunks, keys, "seq", "text", "body")
    head = F.when(F.col("error_seq").isNotNull(), F.concat(F.lit("Error: "), F.coalesce("error_text", F.lit("")))).otherwise("")
    return (state.join(body, keys, "left")
            .select(*keys, F.concat(head, F.coalesce("body", F.lit(""))).alias("content"), "complete"))


def step_states(progress: DataFrame, keys: list[str] = ["request_id"]) -> DataFrame:
    """``(keys, step, place, status, detail)`` from ``(keys, seq, step, detail)``.

    A step seen before turns active with its new detail; a new step first turns the
    active ones done. So a step ends active exactly if its last report is not before
    the first report of the newest step, and two aggregates replace the fold.
    """
    steps = progress.groupBy(*keys, "step").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("detail", "seq").alias("detail"))
    per_request = Window.partitionBy(*keys)
    newest = F.max("first_seq").over(per_request)
    return steps.select(
        *keys, "step", F.row_number().over(per_request.orderBy("first_seq")).alias("place"),
        F.when(F.col("last_seq") >= newest, "active").otherwise("done").alias("status"), "detail")
