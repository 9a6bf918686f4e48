"""Quality rules: lines are judged first, then the document by what it loses.

Each line is held against three kinds of rule:

* punctuation: it has to end like a sentence, and must not be strewn with symbols;
* navigation: it must not be a row of links or cells between separators;
* boilerplate: a short line must not hold a stock phrase of web pages.

Failing lines are removed. A document that loses more than a given share of its word
characters, or fails the base rules, is rejected.

Defined results: a null text counts as empty; an empty text has no words and fails the
base rules; equal rows give equal results; columns other than the text are not read and
pass through, but for one named ``quality``, which is replaced. Windows of words are told apart by a 64-bit hash within
their own text. One row comes out for each row that goes in, and nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.llm.texts import BLANKS, WORD, carried, let, total, unpacked, words

# Ends of sentences, symbols, separators, and stock phrases.
TRAILING = " \t\n\x0b\f\r"
SENTENCE_ENDS = ".!?:;…。！？\"'”’»)]"
SENTENCE_INSIDE = r"[.!?。！？][\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
PHRASES = [
    "all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "log in or sign up",
    "lorem ipsum", "privacy policy", "sign up for our newsletter", "skip to content", "subscribe now", "terms of use",
]

WINDOW = 5
MAX_PHRASE_WORDS = 20
MAX_HEADING_WORDS = 20
MIN_SEPARATORS = 3
MAX_SYMBOL_SHARE = 0.1
MAX_LOST_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _holds_phrase(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in PHRASES]))


def line_fails(line: Column, marks: Column, stock: Column) -> Column:
    """Whether a line that has a word fails one of the rules; ``marks`` and ``stock`` say whether its text has any of them at all.

    A line without an end mark passes if it is long and has sentences inside: a text
    that was cut short. Short ones are headings and menus.
    """
    n_words = F.size(F.split(line, BLANKS))
    ended = F.substring(F.rtrim(line, F.lit(TRAILING)), -1, 1).isin(list(SENTENCE_ENDS))
    no_end = ~ended & ((n_words <= MAX_HEADING_WORDS) | ~line.rlike(SENTENCE_INSIDE))
    strewn = _without(line, SYMBOLS) > MAX_SYMBOL_SHARE * F.length(line)
    navigation = _without(line, SEPARATORS) >= MIN_SEPARATORS
    phrase = F.when(stock, _holds_phrase(line) & (n_words <= MAX_PHRASE_WORDS)).otherwise(False)
    return no_end | F.when(marks, strewn | navigation).otherwise(False) | phrase


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash is there twice or more: windows are sorted by hash, and those beside an equal one kept."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ps: Column) -> Column:
        same = lambda p, i: F.coalesce(F.get(ps, i)["h"] == p["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ps, lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p["i"]))

    def united(places: Column) -> Column:
        return total(F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))).cast("bigint")))

    return let(let(pairs, repeated), united)


def repeated_words(ws: Column) -> Column:
    """How many words lie in a window of five that the text has twice or more."""
    hashes = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, WINDOW)])), 1, F.size(ws) - (WINDOW - 1))
    found = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), _covered(hs)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(ws) > WINDOW, found).otherwise(F.lit(0).cast("bigint"))


def _chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANKS, "")).cast("bigint")


def _of_words(ws: Column) -> Column:
    return F.struct(F.size(ws).cast("bigint").alias("n"), F.aggregate(ws, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("chars"), repeated_words(ws).alias("rep"))


def _of_lines(lines: Column, text: Column) -> Column:
    """Doubled lines, failed lines, and what is left."""
    def judged(marks: Column, stock: Column) -> Column:
        good = F.filter(lines, lambda x: ~line_fails(x, marks, stock))
        return let(good, lambda g: F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("dup"), (F.size(lines) - F.size(g)).alias("bad"), F.array_join(g, "\n").alias("clean")))

    return let(text.rlike("[" + SYMBOLS + SEPARATORS + "]"), lambda marks: let(_holds_phrase(text), lambda stock: judged(marks, stock)))


def _verdict(text: Column, w: Column, l: Column) -> Column:  # noqa: E741
    failed = (w["n"] < MIN_WORDS) | (100 * w["rep"] > MAX_REPEATED_PERCENT * w["n"])
    left = F.when(l["bad"] == 0, w["chars"]).otherwise(_chars(l["clean"]))
    return let(left, lambda left: F.struct(
        w["n"].alias("n_words"), w["chars"].alias("word_chars"), F.length(F.regexp_replace(text, "[^" + SYMBOLS + "]+", "")).cast("bigint").alias("n_symbols"),
        l["dup"].alias("n_dup_lines"), w["rep"].alias("n_repeat_words"), failed.alias("base_failed"), left.alias("kept_chars"),
        (~failed & (w["chars"] - left <= MAX_LOST_SHARE * w["chars"])).alias("kept"), F.when(l["bad"] == 0, text).otherwise(l["clean"]).alias("clean_text")))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``quality``: the counts, the verdicts and the text of the lines that passed.

    A text that loses no line keeps its blank lines too.
    """
    def judged(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        return let(let(words(t), _of_words), lambda w: let(let(lines, lambda ls: _of_lines(ls, t)), lambda ls: _verdict(t, w, ls)))

    return docs.withColumn("quality", let(F.coalesce(F.col(text), F.lit("")), judged))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the lines that passed, in the columns of ``docs``."""
    judged = quality_rules(docs.select(carried(docs), F.col("text"))).where(F.col("quality.kept"))
    return judged.select(*unpacked(docs, {"text": F.col("quality.clean_text"), "n_chars": F.length("quality.clean_text").cast("bigint")}))
