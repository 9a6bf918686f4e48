"""Results under caps: rows, columns, cells, and the length of the shown text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardedlake.functions.ordered import top_per_key
from guardedlake.functions.text import cell_text, markdown_line


class Caps(NamedTuple):
    """The caps a result is shown under unless others are given."""

    rows: int = 50
    columns: int = 20
    cell_chars: int = 200
    output_chars: int = 16_000


def cap_columns(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` columns; the scan reads no others."""
    return df.select(df.columns[:n])


def cap_rows(df: DataFrame, n: int = 50, order: list[Column | str] | None = None) -> DataFrame:
    """At most ``n`` rows, taken inside the plan; with an order, a top-k."""
    return (df.orderBy(*order) if order else df).limit(n)


def cells(df: DataFrame, limit: int = 200) -> DataFrame:
    """Every column as the text it shows as."""
    return df.select([cell_text(F.col(f"`{c}`"), limit).alias(c) for c in df.columns])


def header_text(columns: list[str], limit: int = 200) -> str:
    def short(name: str) -> str:
        return name if len(name) <= limit else f"{name[:limit]}...[{len(name) - limit} more]"

    return "| " + "".join(f"{short(c)} | " for c in columns) + "\n| " + "--- | " * len(columns) + "\n"


def within_budget(lines: DataFrame, header_chars: int, caps: Caps = Caps()) -> DataFrame:
    """Number the lines of each result as ``n`` and say which are ``shown``.

    Every result is cut to the row cap first, per map task, so the running length is
    taken over that many rows at most. A line is shown if it is the first or if the
    text before it is within the budget.
    """
    capped = top_per_key(lines, ["result_id"], [F.col("pos")], caps.rows, "n")
    before = Window.partitionBy("result_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    used = F.lit(header_chars) + F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    return capped.withColumn("shown", (F.col("n") == 1) | (used <= caps.output_chars))


def render(lines: DataFrame, header: str, caps: Caps = Caps()) -> DataFrame:
    """One markdown text per result from ``(result_id, pos, line)``.

    See ``within_budget`` for which lines are shown; no group is larger than the cap.
    """
    shown = within_budget(lines, len(header), caps)
    grouped = shown.groupBy("result_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("shown").alias("shown_count"),
        F.sum(F.when(F.col("shown"), F.length("line") + 1)).alias("shown_chars"),
        F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("n", "line")))).alias("l"))
    body = F.concat(F.lit(header), F.array_join(F.transform("l", lambda e: F.concat(e["line"], F.lit("\n"))), ""))
    # The note follows whichever line first carried the text past the budget, even the last.
    over = F.lit(len(header)) + F.col("shown_chars") > caps.output_chars
    note = F.when(over, F.format_string("\n... (output truncated, showing %d of %d rows)\n", "shown_count", "row_count")).otherwise("")
    return grouped.select(
        "result_id", F.concat(body, note, footer(F.col("row_count"), caps.rows)).alias("markdown"),
        "row_count", over.alias("truncated"), (F.col("row_count") >= caps.rows).alias("limit_reached"))


def footer(row_count: Column, cap: int) -> Column:
    return F.concat(F.lit("\n_"), row_count.cast("string"), F.lit(" row(s) returned"),
                    F.when(row_count >= cap, " (limit reached)").otherwise(""), F.lit("_"))


def render_result(df: DataFrame, order: list[Column | str] | None = None, caps: Caps = Caps()) -> DataFrame:
    """The markdown of one result, as one row; an empty result keeps its header."""
    if not df.columns:
        return df.sparkSession.range(1).select(F.lit("(empty result set)").alias("markdown"), F.lit(0).cast("long").alias("row_count"),
                                               F.lit(False).alias("truncated"), F.lit(False).alias("limit_reached"))
    top = cap_rows(cap_columns(df, caps.columns), caps.rows, order)
    shown = cells(top, caps.cell_chars)
    header = header_text(shown.columns, caps.cell_chars)
    # monotonically_increasing_id follows the order that limit fixed: one partition of at most cap rows.
    lines = shown.coalesce(1).select(F.lit(0).alias("result_id"), F.monotonically_increasing_id().alias("pos"),
                                     markdown_line([F.col(f"`{c}`") for c in shown.columns]).alias("line"))
    one = df.sparkSession.range(1).select(F.lit(0).alias("result_id"))
    return (one.join(render(lines, header, caps), "result_id", "left")
            .select(F.coalesce("markdown", F.lit(header + "\n_0 row(s) returned_")).alias("markdown"),
                    F.coalesce("row_count", F.lit(0)).alias("row_count"),
                    F.coalesce("truncated", F.lit(False)).alias("truncated"),
                    F.coalesce("limit_reached", F.lit(False)).alias("limit_reached")))
