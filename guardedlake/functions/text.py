"""Text expressions shared by the operators; all are plain column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


WHITE_SPACE = " \t\n\r\f\x0b"


def strip(col: Column | str) -> Column:
    """Trim every kind of white space; ``trim`` without a set drops blanks only."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | ~c.rlike(r"\S")


def slug(col: Column | str, limit: int = 80) -> Column:
    """Lower case, other runs to ``-``, trimmed, cut, trimmed again."""
    dashed = F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(dashed, 1, limit), F.lit("-"))


def shorten(col: Column | str, limit: int) -> Column:
    """Cut to ``limit`` characters and say how many more there were."""
    c = F.col(col) if isinstance(col, str) else col
    more = (F.length(c) - limit).cast("string")
    return F.when(F.length(c) > limit,
                  F.concat(F.substring(c, 1, limit), F.lit("...["), more, F.lit(" more]"))).otherwise(c)


def cell_text(col: Column | str, limit: int = 200) -> Column:
    """The text a value shows as: null is the word ``NULL``."""
    c = F.col(col) if isinstance(col, str) else col
    return shorten(F.coalesce(c.cast("string"), F.lit("NULL")), limit)


def sample_cell(col: Column | str, limit: int = 120) -> Column:
    """A sample value: cut with dots first, then pipes are escaped."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.coalesce(c.cast("string"), F.lit("NULL"))
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
    return F.replace(cut, F.lit("|"), F.lit("\\|"))


def markdown_line(cells: Column | list[Column]) -> Column:
    """``| a | b | `` from an array column or a list of columns."""
    joined = F.concat_ws(" | ", *cells) if isinstance(cells, list) else F.array_join(cells, " | ")
    return F.concat(F.lit("| "), joined, F.lit(" | "))


def label(col: Column | str, limit: int = 40) -> Column:
    """A list label: cut with an ellipsis."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def words(col: Column | str) -> Column:
    """Every occurrence of a lower-case ASCII word longer than one character."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"\w{2,}"), 0)


def tokens(col: Column | str) -> Column:
    """Distinct lower-case ASCII words longer than one character."""
    return F.array_distinct(words(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))))


def quality_score(col: Column | str, default: float = 0.5) -> Column:
    """First decimal number or lone 0/1 in the text, clamped to [0, 1].

    The clamp sits inside the ``when``: ``least`` and ``greatest`` skip nulls, so
    a missing number would otherwise come out as 0.
    """
    found = F.regexp_extract(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")),
                             r"([0-9]+\.[0-9]+|[01])", 1)
    score = found.try_cast("double")
    return (F.when((found == "") | score.isNull(), F.lit(default))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))


def currency(col: Column | str) -> Column:
    """``$1,234.50``, the sign in front of the symbol."""
    c = F.round(F.col(col) if isinstance(col, str) else col, 2)
    return F.concat(F.when(c < 0, "-$").otherwise("$"), F.format_number(F.abs(c), 2))


# Account classes by code range, both ends included.
ACCOUNT_CLASSES = (
    (1000, 1999, "ASSET"),
    (2000, 2999, "LIABILITY"),
    (3000, 3999, "EQUITY"),
    (4000, 4999, "REVENUE"),
    (5000, 6999, "EXPENSE"),
)


def account_class(code: Column | str) -> Column:
    """The class of an account code; null outside every range."""
    c = (F.col(code) if isinstance(code, str) else code).cast("int")
    out = F.lit(None).cast("string")
    for low, high, name in reversed(ACCOUNT_CLASSES):
        out = F.when(c.between(low, high), name).otherwise(out)
    return out


def ascii_word(alternatives: list[str]) -> str:
    """A pattern for whole words in any case, of ASCII letters, digits and ``_``.

    ``\\b`` changed its meaning between Java releases; ``\\w`` did not.
    """
    body = "|".join(re.sub(r" +", r"\\s+", a) for a in alternatives)
    return rf"(?<!\w)(?i:{body})(?!\w)"
