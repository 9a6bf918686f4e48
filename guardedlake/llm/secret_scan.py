"""Secret scans by a trigram inverted index.

Every rule is a regular expression. From each one a Boolean query over trigrams is
derived: an AND of ORs that any matching text has to satisfy. One scan of the texts
writes the postings of all trigrams that some query asks for, one row a trigram and
text, ordered by trigram in each file. A rule's postings are intersected by text: an OR
is met by any of its trigrams, an AND when all its ORs are met. What is left, the
candidates, are joined back to their texts, and only the rules that name a text as a
candidate are run on it; a rule without a mandatory trigram is run on all.

A text is known by its 64-bit hash, so copies share their postings, a hot text is one
row a task after the map-side step, and two texts that share a hash by chance only make
more candidates for the check. Candidates are written before the join: Spark knows their
size, sends them out where that is below its threshold, and else shuffles texts once.

Of a query's clauses the three most telling are kept; fewer clauses of an AND only let
more candidates through to the check.

Defined results: a null text counts as empty and holds nothing; equal rows give equal
results; very long texts are scanned whole; an empty table gives none. One row comes out
for each row that goes in, with all its columns; the column of results takes the place
of one that has its name, which ``into`` can change. Other columns are not read.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as C
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.llm.texts import SPAN, carried, joined, let, spans, text_of, unpacked
from guardedlake.session import materialise

Query = tuple[frozenset[str], ...]  # an AND of ORs; no clause at all: any text may match

MAX_CLASS = 8
MAX_STRINGS = 64
MAX_CLAUSES = 3


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int = 0
    check: str = ""  # what the match has to look like; a match that fails is dropped, not tried again


# The base rules, then formats that their issuers publish.
ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = [
    Rule("assign", ASSIGNED + "[A-Za-z0-9+/_.=-]+", check=f"^{ASSIGNED}[A-Za-z0-9+/_.=-]{{12,}}$"),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
]
KNOWN = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!-]{4,}@"),
]


def _strings(node, fold: bool) -> list[str] | None:
    """All strings that an element of a parsed pattern stands for, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN and arg[0][0] is not C.NEGATE:
        chars: list[str] = []
        for kind, value in arg:
            if kind is C.LITERAL:
                chars.append(chr(value).lower())
            elif kind is C.RANGE and value[1] - value[0] < MAX_CLASS:
                chars += [chr(c).lower() for c in range(value[0], value[1] + 1)]
            else:
                return None
        return sorted(set(chars)) if len(chars) <= MAX_CLASS else None
    if op is C.SUBPATTERN:
        return _sequence(arg[-1], fold)
    if op is C.BRANCH:
        parts = [_sequence(b, fold) for b in arg[1]]
        return None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2], fold)
        return None if inner is None else sorted({*inner, *([""] if arg[0] == 0 else [])})
    return None


def _sequence(nodes, fold: bool) -> list[str] | None:
    found = [""]
    for node in nodes:
        more = _strings(node, fold)
        if more is None or len(found) * len(more) > MAX_STRINGS:
            return None
        found = [a + b for a, b in product(found, more)]
    return found


def _clauses(strings: list[str]) -> Query:
    """What all of some strings ask for: each position of the shortest, by all strings at once."""
    grams = [[s[i:i + 3] for i in range(len(s) - 2)] for s in strings]
    if not all(grams):
        return ()
    short = min(map(len, grams))
    return tuple(frozenset(g[i] for g in grams) for i in range(short))


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that any text has to hold for ``pattern`` to match in it."""
    def walk(nodes) -> Query:
        clauses: list[frozenset[str]] = []
        run = [""]

        def close() -> None:
            nonlocal run
            clauses.extend(_clauses(run))
            run = [""]

        for node in nodes:
            more = _strings(node, True)
            if more is not None and len(run) * len(more) <= MAX_STRINGS:
                run = [a + b for a, b in product(run, more)]
                continue
            close()
            if more is not None:
                run = more
            elif node[0] is C.SUBPATTERN:
                clauses.extend(walk(node[1][-1]))
            elif node[0] in (C.MAX_REPEAT, C.MIN_REPEAT) and node[1][0] > 0:
                clauses.extend(walk(node[1][2]))
        close()
        return tuple(clauses)

    clauses = dict.fromkeys(walk(parser.parse(re.sub(r"\(\?i:", "(?:", pattern))))
    telling = sorted(clauses, key=lambda c: (len(c), -sum(not x.isalpha() for g in c for x in g) / len(c)))
    return tuple(telling[:MAX_CLAUSES])


class Index(NamedTuple):
    """Trigrams that the queries of some rules ask for, and those queries by the trigrams' places."""

    grams: list[str]
    queries: list[list[list[int]]]

    @classmethod
    def of(cls, rules: list[Rule]) -> Index:
        queries = [trigram_query(r.pattern) for r in rules]
        grams = sorted({g for q in queries for clause in q for g in clause})
        place = {g: i for i, g in enumerate(grams)}
        return cls(grams, [[sorted(place[g] for g in clause) for clause in q] for q in queries])

    def held(self, text: Column) -> Column:
        """Places of the trigrams that a text holds."""
        return let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(self.grams)])))

    def asked_by(self, gram: Column) -> Column:
        """The rules that a trigram is part of, and the clause there as a bit."""
        uses: list[list[Column]] = [[] for _ in self.grams]
        for rule, query in enumerate(self.queries):
            for clause, places in enumerate(query):
                for place in places:
                    uses[place].append(F.struct(F.lit(rule).alias("rule"), F.lit(1 << clause).alias("clause")))
        return F.get(F.array(*[F.array(*u) for u in uses]), gram)


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """The inverted index to store: gram (its place in ``index``) and _key of each text that holds it, by gram in each part."""
    held = docs.select(key_of(text_of(text)).alias("_key"), F.explode(index.held(text_of(text))).alias("gram"))
    return held.select("gram", "_key").sortWithinPartitions("gram", "_key")


def candidates(stored: DataFrame, index: Index) -> DataFrame:
    """_key, rules: the rules whose query a text's postings satisfy."""
    asked = stored.select("_key", F.explode(index.asked_by(F.col("gram"))).alias("use")).select("_key", "use.rule", "use.clause")
    met = asked.groupBy("_key", "rule").agg(F.bit_or("clause").alias("met"))
    wanted = F.get(F.array(*[F.lit((1 << len(q)) - 1) for q in index.queries]), F.col("rule"))
    return met.where(F.col("met") == wanted).groupBy("_key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _matches(text: Column, rule: Rule) -> Column:
    good = None
    if rule.least or rule.check:
        def good(m: Column) -> Column:
            long = F.length(m) >= rule.least
            return long & m.rlike(rule.check) if rule.check else long
    return spans(text, rule.pattern, good)


def secret_scan(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with an array of spans for each rule, in the order of the rules, as column ``into``."""
    rules = BASE + KNOWN if rules is None else rules
    index = Index.of(rules)
    row = docs.select(carried(docs))
    body = text_of(f"_row.`{text}`")
    none = F.array().cast(SPAN)
    if index.grams:
        stored = materialise(postings(docs, index, f"`{text}`"), "secret-postings")
        named = materialise(candidates(stored, index), "secret-candidates")
        row = row.withColumn("_key", key_of(body)).join(named, "_key", "left")

    def found(t: Column) -> Column:
        return F.array(*[F.when(F.array_contains("rules", i), _matches(t, r)).otherwise(none) if index.queries[i] else _matches(t, r) for i, r in enumerate(rules)])

    own = [c for c, name in zip(unpacked(docs, {}), docs.columns, strict=True) if name != into]
    return row.select(*own, let(body, found).alias(into))


def by_start(found: Column, kinds: int) -> Column:
    """The spans of the first ``kinds`` rules in one list: by start, then rule."""
    rows = F.flatten(F.transform(F.slice(found, 1, kinds), lambda s, k: F.transform(s, lambda x: F.struct(x["start"].alias("start"), k.alias("kind"), x["end"].alias("end")))))
    return F.sort_array(rows)


def scan_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans."""
    rules = BASE + KNOWN
    names = [r.kind for r in rules]
    s = F.col("secrets")
    count = lambda i: F.size(F.get(s, F.lit(i))).cast("bigint")
    return secret_scan(docs.select("doc_id", "text"), rules).select(
        "doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(joined(by_start(s, len(BASE)), names), 256).alias("base_sha256"), joined(by_start(s, len(rules)), names).alias("spans"))
