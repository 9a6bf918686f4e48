"""Quality rules, secret scans and personal data beside plain Python."""

import hashlib
import re
from collections import Counter

import pytest

from guardedlake.llm import pii, quality_rules, secret_scan
from tests.conftest import plan

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def counts(text):
    ws = WORDS.findall(text or "")
    seen = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if seen[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def secrets(text):
    text, found = text or "", []
    found += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def good(kind, match):
    d = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def personal(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PERSONAL.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def pairs(df, expected, result):
    """Rows of both sides as multisets, so that repeated rows count."""
    want = Counter((r["doc_id"], expected(r["text"])) for r in df.select("doc_id", "text").collect())
    assert Counter(result) == want


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_quality_counts(request, table):
    df = request.getfixturevalue(table)
    got = quality_rules.quality_rules(df.select("doc_id", "text")).select("doc_id", "quality.*").collect()
    pairs(df, counts, [(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_lines_are_judged_first(spark):
    prose, more = "This is a clean line of text that says something.", "Here comes another one, which tells what happened after that."
    texts = {1: f"{prose}\nHome | About | News | Contact |\n{more}\nAll rights reserved.\nA heading", 2: "\n".join([prose] + [f"a{i} | b{i} | c{i} | d{i} | e{i} |" for i in range(9)]),
             3: f"{prose}\n\n{more} And then there is no end to this line, as whoever wrote it was cut short before"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).select("doc_id", "quality.*").collect()}
    assert got[1]["clean_text"] == f"{prose}\n{more}" and got[1]["kept"]
    assert not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["clean_text"] == texts[3]


def test_kept_documents_keep_their_columns(odd):
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns
    assert all(r["quality"] == "own quality" for r in kept.collect())


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_secrets(request, table):
    df = request.getfixturevalue(table)
    got = secret_scan.scan_digest(df)
    pairs(df, lambda t: digest(secrets(t)), [(r["doc_id"], r["base_sha256"]) for r in got.collect()])
    assert table != "docs" or "hashpartitioning" not in plan(got)  # few candidates are sent to the texts, which stay


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_texts_are_moved_where_candidates_are_many(spark, request, table):
    """The same rows where Spark may not send the candidates out."""
    df = request.getfixturevalue(table)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = Counter(map(tuple, secret_scan.scan_digest(df).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = secret_scan.scan_digest(df)
        assert (table == "empty" or "hashpartitioning" in plan(got)) and Counter(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scan_keeps_all_columns(odd, empty):
    got = secret_scan.secret_scan(odd, into="spans of rules")
    assert got.columns == [*odd.columns, "spans of rules"] and got.count() == odd.count()
    assert sorted(secret_scan.secret_scan(odd).columns) == sorted(odd.columns)
    assert secret_scan.secret_scan(odd, [secret_scan.BASE[2]]).count() == odd.count() and secret_scan.secret_scan(empty).count() == 0


def test_the_value_alone_has_to_be_long(spark):
    values = ["abc", "short", "abcd1", "a" * 11, "a" * 12, "=" * 11, "=" * 12, "token=abcdef", "secret=abcde"]
    texts = [f"x {k}{s}{v}" for k in ("password", "SECRET", "api_key", "apikey", "token") for s in ("=", ":", " = ", "='", '": "') for v in values]
    df = spark.createDataFrame(list(enumerate([*texts, " ".join(texts), "token=abc\npassword=abcdefghijkl\n"])), "doc_id bigint, text string")
    got = secret_scan.scan_digest(df).collect()
    pairs(df, lambda t: digest(secrets(t)), [(r["doc_id"], r["base_sha256"]) for r in got])
    pairs(df, lambda t: sum(x.startswith("assign") for x in secrets(t)), [(r["doc_id"], r["n_assign"]) for r in got])
    assert got[0]["spans"] == "" and got[4]["spans"] == "assign:2:23"


def test_known_formats(spark):
    texts = ["x ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "see https://user:pass@host/", "AIza" + "x" * 35, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"].split(":")[0] for r in secret_scan.scan_digest(df).collect()}
    assert got == {0: "github", 1: "private_key", 2: "url_login", 3: "google", 4: "jwt", 5: ""}


def test_each_format_is_found_alone_and_among_others(spark):
    """One text of each published format, one that just fails it, and all of them in one text."""
    def word(n, kinds="aB3x"):
        return (kinds * n)[:n]

    good = {"gitlab": "glpat-" + word(20, "aB3_-"), "slack": "xoxb-" + word(10, "a1-"), "stripe": "sk_live_" + word(16), "npm": "npm_" + word(36), "sendgrid": "SG." + word(22) + "." + word(43)}
    bad = ["glpat-" + word(19), "xoxc-" + word(12), "sk_prod_" + word(16), "npm_" + word(35), "SG." + word(22) + "." + word(42)]
    texts = ["é " + t for t in good.values()] + ["é " + t for t in bad] + ["\n".join(["no", *good.values(), *bad])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_digest(df).collect()}
    for i, (kind, text) in enumerate(good.items()):
        assert got[i] == f"{kind}:2:{2 + len(text)}"
    assert not any(got[len(good) + i] for i in range(len(bad)))
    at, want = 3, []
    for kind, text in good.items():
        want.append(f"{kind}:{at}:{at + len(text)}")
        at += len(text) + 1
    assert got[len(texts) - 1] == ",".join(want)


def test_queries_never_refuse_a_match(spark):
    assert secret_scan.trigram_query("[0-9a-f]+") == ()
    assert secret_scan.trigram_query("(abcd|xyz)e") and secret_scan.trigram_query("ab?c") == ()
    for rule in secret_scan.BASE + secret_scan.KNOWN:
        for clause in secret_scan.trigram_query(rule.pattern):
            assert all(len(g) == 3 and g == g.lower() for g in clause)


def test_postings_and_their_intersection(odd, docs):
    """Postings beside a search of every text for every trigram, candidates beside each rule's query on each text."""
    rules = secret_scan.BASE + secret_scan.KNOWN
    index = secret_scan.Index.of(rules)
    for df in (odd, docs):
        texts = {r["k"]: r["t"] for r in df.selectExpr("xxhash64(coalesce(text, '')) AS k", "lower(coalesce(text, '')) AS t").collect()}
        stored = secret_scan.postings(df, index)
        got = {(r["gram"], r["_key"]) for r in stored.collect()}
        assert got == {(i, k) for k, t in texts.items() for i, g in enumerate(index.grams) if g in t}
        named = {r["_key"]: r["rules"] for r in secret_scan.candidates(stored, index).collect()}
        want = {k: [i for i, r in enumerate(rules) if (q := secret_scan.trigram_query(r.pattern)) and all(any(g in t for g in c) for c in q)] for k, t in texts.items()}
        assert named == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("table", ["odd", "docs", "empty"])
def test_personal_data(request, table):
    df = request.getfixturevalue(table)
    got = pii.digest(df).collect()
    pairs(df, lambda t: digest(personal(t)), [(r["doc_id"], r["base_sha256"]) for r in got])
    texts = {(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
    for r in got:
        assert any(d == r["doc_id"] and set(personal(t)) <= set(r["spans"].split(",")) for d, t in texts)


def test_contexts_give_unknown_identifiers_away(spark):
    known = [(i, f"Call me at +1 555 020{i:04} now. f{i}") for i in range(30)]
    hidden = [(100 + i, f"Call me at (555) 010-{i:04} now. e{i}") for i in range(12)]
    plain = [(200 + i, f"The sum of 1234567{i} was paid. g{i}") for i in range(12)]
    df = spark.createDataFrame(known + hidden + plain, "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    assert all(got[i] == "phone:11:25" for i, _ in hidden) and all(got[i] == "" for i, _ in plain)
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert redacted[100] == "Call me at [PHONE] now. e0" and redacted[200] == plain[0][1]


def test_found_identifiers_give_further_ones_away(spark):
    """Each context holds those of the contexts before it and ten of its own; only the first holds any that a base pattern knows."""
    contexts = ["Call me at {} now.", "Dial up number {} today.", "Ask for line {} please.", "Ring on extension {} tonight.", "Phone the desk {} first.", "Reach us under {} soon."]
    rows = [contexts[0].format(f"+1 555 020{i:04}") for i in range(60)]
    ids = [[f"(555) 01{k}-{i:04}" for i in range(10 if k else 30)] for k in range(len(contexts))]
    rows += [context.format(x) for k, context in enumerate(contexts) for own in ids[:k + 1] for x in own]
    rows += [f"The sum of 1234567{i} was paid." for i in range(12)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    for i, text in enumerate(rows):
        assert got[i].startswith("phone:") != text.startswith("The sum"), text


@pytest.mark.parametrize("shift", [0, 200])
def test_contexts_are_whole_words(spark, shift):
    """Words that end alike, however long, are different contexts."""
    known, other = "a" * 7 + "z" * (64 + shift), "b" * 9 + "z" * (64 + shift)
    ids = [f"(555) 01{i:05}" for i in range(24)]
    rows = [f"word {known} +1 555 020{i:04} end" for i in range(60)] + [f"word {known} {x} end" for x in ids[:12]] + [f"word {other} {x} end" for x in ids[12:]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(df).collect()}
    assert all(got[i].startswith("phone:") == (known in text) for i, text in enumerate(rows))


def test_redaction_keeps_columns(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r["_id"] for r in out.collect()} == {"own _id"}
