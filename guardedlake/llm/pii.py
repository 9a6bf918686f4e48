"""Personal data: base patterns, and identifiers that are found by the words around them.

The base kinds are regular expressions with a check of each match. From what they find
(the seeds) the operator learns further: every identifier-like piece of text is an
instance, the words around it are lexical patterns, and both are nodes of a graph. By
turns a pattern is scored by the share of its instances that count as one kind of
personal data, and an instance by the best pattern it stands in. Patterns of high
confidence thus give away identifiers whose form no base pattern knows, and those count
for further patterns, by their scores, until no score changes any more. Scores only
rise from round to round and are whole numbers of millionths, so this comes to an end,
and the order in which a shuffle delivers rows changes nothing. An instance that is not
known yet counts against its patterns.

Defined results: a null text counts as empty and holds nothing; equal rows give equal
results; texts of any length are searched whole. One row comes out for each row that
goes in. Rows whose id is null keep their base spans and take part in scoring, but get
no added spans. Added spans never remove base ones. Of other columns none is read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.llm.sieve import may_match
from guardedlake.llm.texts import SPAN, carried, cut, joined, let, spans, text_of, unpacked
from guardedlake.session import materialise


class Kind(NamedTuple):
    name: str
    pattern: str
    good: Callable[[Column], Column] | None = None
    needs: str = ""


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a short string of digits: every second one from the right is doubled."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


# The base kinds in their order. A run is entered at its first character
# or where the last match ended, and never given back, so that no text is scanned twice.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, needs="+"),
]
# What an identifier may look like: something around an @, or seven digits and more.
INSTANCE = r"(?:\G|(?<![^\x20\x09-\x0D@]))[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++|[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
# A word and the blanks before it.
ONE = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"

MIN_SUPPORT = 3
CONFIDENT = 600_000
SURE = 1_000_000
SCORES = [f"s_{k.name}" for k in KINDS]


def base_spans(text: Column) -> Column:
    """An array of spans for each base kind."""
    none = F.array().cast(SPAN)
    return F.array(*[F.when(F.contains(text, F.lit(k.needs)), spans(text, k.pattern, k.good)).otherwise(none) if k.needs else spans(text, k.pattern, k.good) for k in KINDS])


def _last_words(text: Column) -> Column:
    """The last two words of a text with the blanks behind them, found from its end."""
    return F.reverse(F.regexp_extract(F.reverse(text), rf"^{ONE}(?:{ONE})?", 0))


def _instances(text: Column) -> Column:
    """Identifier-like pieces with their places and what stands around them."""
    def body(c):
        places = F.sequence(F.lit(0), F.size(c.matches) - 1)
        return F.transform(places, lambda i: F.struct(
            F.get(c.starts, i).alias("start"), (F.get(c.starts, i) + F.length(F.get(c.matches, i))).alias("end"), F.get(c.matches, i).alias("match"),
            _last_words(F.get(c.pieces, i)).alias("before"), F.regexp_extract(F.get(c.pieces, i + 1), rf"^{ONE}", 0).alias("after")))

    return cut(text, INSTANCE, body, F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"))


def _kind_of(match: Column) -> Column:
    """The first base kind that an instance holds a match of, if any."""
    out = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(KINDS))):
        out = F.when(F.size(spans(match, k.pattern, k.good)) > 0, i).otherwise(out)
    return out


def _patterns() -> Column:
    """The lexical patterns of an instance: the two words before it, and the words on both sides."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    two = F.regexp_extract(plain(F.col("before")), r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    one = F.regexp_extract(plain(F.col("before")), r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    nxt = F.regexp_extract(plain(F.col("after")), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    return F.filter(F.array(F.when(two != "", F.concat(F.lit("2 "), two)), F.when((one != "") & (nxt != ""), F.concat_ws(" ", F.lit("1"), one, F.lit("_"), nxt))), lambda p: p.isNotNull())


def _scored(edges: DataFrame) -> DataFrame:
    """The confidence of each pattern for each kind; a pattern needs some instances that are seeds or were accepted."""
    support = f"count_if(greatest({', '.join(SCORES)}) > 0)"
    share = [F.expr(f"CASE WHEN {support} >= {MIN_SUPPORT} THEN sum({s}) DIV (count(*) + 1) ELSE 0 END").alias(s) for s in SCORES]
    return edges.groupBy("pattern").agg(*share)


def discovered(found: DataFrame) -> DataFrame:
    """Spans of identifiers that no base pattern knows: _id, _hash, kind, start, end. ``found`` has _id, _hash, _instances."""
    one = found.select("_id", "_hash", F.explode("_instances").alias("i")).select("_id", "_hash", "i.start", "i.end", F.col("i.match").alias("instance"), "i.before", "i.after", _kind_of(F.col("i.match")).alias("kind"))
    seen = materialise(one.select("_id", "_hash", "start", "end", "instance", "kind", _patterns().alias("patterns")), "pii-instances")
    start = [F.max(F.when(F.col("kind") == i, SURE).otherwise(0)).cast("bigint").alias(s) for i, s in enumerate(SCORES)]
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(*start, F.max(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).alias("seed"))
    edges = materialise(edges, "pii-edges")
    total = F.sum(sum(F.col(s) for s in SCORES))
    before, now = None, edges.select(total).first()[0]
    while now != before:
        marked = edges.select("pattern", "instance").join(_scored(edges), "pattern").groupBy("instance").agg(*[F.max(s).alias(f"new_{s}") for s in SCORES])
        marked = materialise(marked, "pii-scores")
        taken = [F.when(F.col("seed") == 1, F.col(s)).otherwise(F.when(F.col(f"new_{s}") >= CONFIDENT, F.col(f"new_{s}")).otherwise(0)).cast("bigint").alias(s) for s in SCORES]
        edges = materialise(edges.join(marked, "instance").select("pattern", "instance", *taken, "seed"), "pii-edges")
        before, now = now, edges.select(total).first()[0]
    best = F.greatest(*SCORES)
    names = F.coalesce(*[F.when(F.col(s) == best, i) for i, s in enumerate(SCORES)])
    accepted = edges.where((F.col("seed") == 0) & (best >= CONFIDENT)).select("instance", names.alias("kind")).groupBy("instance").agg(F.min("kind").alias("kind"))
    return seen.where("kind IS NULL AND _id IS NOT NULL").select("_id", "_hash", "start", "end", "instance").join(accepted, "instance").select("_id", "_hash", "kind", "start", "end")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: _id, _hash (of the text), base (spans by kind) and all_spans (kind, start, end) in order of kind and start."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("_id"), text_of(text).alias("_text"))
    found = source.select("_id", F.xxhash64("_text").alias("_hash"), base_spans(F.col("_text")).alias("base"), _instances(F.col("_text")).alias("_instances"))
    found = materialise(found, "pii-base")
    new = discovered(found).groupBy("_id", "_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_new"))
    flat = F.flatten(F.transform("base", lambda s, k: F.transform(s, lambda x: F.struct(k.alias("kind"), x["start"].alias("start"), x["end"].alias("end")))))
    both = F.concat(flat, F.coalesce("_new", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    return found.join(new, ["_id", "_hash"], "left").select("_id", "_hash", "base", F.sort_array(F.array_distinct(both)).alias("all_spans"), F.sort_array(flat).alias("base_spans"))


def digest(docs: DataFrame) -> DataFrame:
    names = [k.name for k in KINDS]
    counts = [F.size(F.get("base", F.lit(i))).cast("bigint").alias(f"n_{n}") for i, n in enumerate(names)]
    return personal_data(docs).select(F.col("_id").alias("doc_id"), *counts, F.sha2(joined(F.col("base_spans"), names), 256).alias("base_sha256"), joined(F.col("all_spans"), names).alias("spans"))


def _redacted(text: Column, found: Column) -> Column:
    """``text`` with a mark for each span; a span that begins inside an earlier one adds to its cut."""
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    order = F.sort_array(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def rebuilt(rows: Column) -> Column:
        first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, x: Column) -> Column:
            gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
            part = F.when(x["start"] >= acc["at"], F.concat(gap, F.get(names, x["kind"]))).otherwise("")
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))

        end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
        return F.aggregate(rows, first, step, end)

    return F.when(F.size(found) > 0, let(order, rebuilt)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with a mark in place of each span of personal data, in the columns of ``docs``.

    Only texts that may hold spans meet them; the others stay where they are.
    """
    found = materialise(personal_data(docs).where(F.size("all_spans") > 0).groupBy("_id", "_hash").agg(F.first("all_spans").alias("_spans")), "pii-spans")
    keyed = docs.select(carried(docs), F.col("doc_id").cast("bigint").alias("_key"), F.xxhash64(text_of()).alias("_hash"), F.col("text").alias("_text"))
    held = may_match(found, ["_id", "_hash"])("_key", "_hash")
    both = keyed.where(held).join(found.withColumnRenamed("_hash", "_found_hash"), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_found_hash")), "left")
    marked = F.when(F.col("_spans").isNotNull(), _redacted(F.col("_text"), F.col("_spans"))).otherwise(F.col("_text"))
    columns = lambda text: unpacked(docs, {"text": text, "n_chars": F.coalesce(F.length(text).cast("bigint"), F.lit(0).cast("bigint"))})
    return keyed.where(~held).select(*columns(F.col("_text"))).union(both.select(*columns(marked)))
