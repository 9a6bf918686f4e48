import random

import pytest
from pyspark.sql import functions as F

from guardedlake.functions import automaton
from guardedlake.operators import policy, route
from tests.conftest import rows

AGENTS = [route.Agent("sql", ["Sql", "query", "table", "group by"]), route.Agent("docs", ["page", "table"]), route.Agent("off", ["sql"], healthy=False)]


def requests(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id int, query string").coalesce(1)


def routed(df):
    return {r["request_id"]: (r["targets"], r["confidence"], r["reasoning"], r["fallback"]) for r in df.collect()}


def test_scores(spark):
    got = sorted(rows(route.keyword_scores(requests(spark, "SQL table, a query!", "x y", None, "group by"), AGENTS)))
    assert got == [(0, "docs", 1 / 3), (0, "off", 1 / 3), (0, "sql", 1.0)]


def test_the_last_registration_holds(spark):
    twice = [route.Agent("x", ["alpha"]), route.Agent("x", ["alpha", "beta"])]
    assert rows(route.keyword_scores(requests(spark, "alpha beta"), twice)) == [(0, "x", 1.0)]
    assert routed(route.route(requests(spark, "alpha beta"), twice))[0][0] == ["x"]


def test_many_agents(spark):
    many = [route.Agent(f"a{i:03}", ["common", f"word{i}"]) for i in range(450)]
    got = dict(((r, a), s) for r, a, s in rows(route.keyword_scores(requests(spark, "common word7"), many)))
    assert len(got) == 450 and got[0, "a007"] == 1.0 and got[0, "a008"] == 0.5


def test_one_reply_counts(spark):
    said = spark.createDataFrame([(0, 1, '{"agents": ["docs"]}'), (0, 2, '{"agents": ["sql"]}')], "request_id int, seq int, reply string")
    assert routed(route.route(requests(spark, "maybe"), AGENTS, said)) == {0: (["sql"], 0.8, "LLM classification", False)}


def test_route_ladder(spark):
    got = routed(route.route(requests(spark, "sql query", "page table", "sql of the day today", "nothing here", ""), AGENTS))
    assert got[0] == (["sql"], 1.0, "Keyword match", False)
    assert got[1] == (["docs"], 1.0, "Keyword match", False)
    assert got[2] == (["sql"], 0.2, "Best keyword match (below threshold, no LLM available)", True)
    assert got[3] == got[4] == ([], 0.0, "No matching agents found and no LLM available", True)
    both = routed(route.route(requests(spark, "table"), AGENTS))
    assert both[0][0] == ["docs", "sql"]
    assert routed(route.route(requests(spark, "sql"), [AGENTS[2]]))[0] == ([], 0.0, "No agents available", False)


def test_route_with_replies(spark):
    asked = requests(spark, "sql", "maybe", "unknown", "broken", "silent")
    said = spark.createDataFrame([(0, '{"agents": ["docs"]}'), (1, '{"agents" : ["docs", "sql", "ghost"], "reasoning": "both"}'), (2, '{"agents": ["ghost"], "reasoning": "none"}'),
                                  (3, "no json"), (4, None)], "request_id int, reply string")
    got = routed(route.route(asked, AGENTS, said))
    assert got[0] == (["sql"], 1.0, "Keyword match", False)
    assert got[1] == (["docs", "sql"], 0.8, "both", False)
    assert got[2] == ([], 0.0, "none", False)
    assert got[3] == ([], 0.0, "LLM classification", False)
    assert got[4] == ([], 0.0, "LLM routing failed: no reply", True)


def test_resolution(spark):
    routes = spark.createDataFrame([(1, ["docs", "ghost", "sql"]), (2, ["off"]), (3, [])], "request_id int, targets array<string>")
    found, lost = route.resolve_agents(routes, route.agents_frame(spark, AGENTS))
    assert sorted(rows(found)) == [(1, 0, "docs"), (1, 2, "sql")]
    assert sorted(r["request_id"] for r in lost.collect()) == [2, 3]


def test_agent_catalog(spark):
    reg = spark.sql("""SELECT 'a' AS agent, 'old' AS description, array(named_struct('name', 'x', 'description', 'does x')) AS capabilities, array('k2', 'k1') AS keywords, 1 AS pos
        UNION ALL SELECT 'a', 'new', array(named_struct('name', 'y', 'description', 'does y')), array('k2', 'k1'), 2
        UNION ALL SELECT 'b', 'bare', array(), array(), 1""")
    doc = route.agents_document(route.registered_agents(reg)).first()["document"]
    assert doc == ("# Registered Sub-Agents\n\n## a\n**Description:** new\n\n**Capabilities:**\n- **y**: does y\n\n**Keywords:** k1, k2\n\n## b\n**Description:** bare\n\n")
    assert route.agents_document(reg.where("false")).first()["document"] == "No agents registered."


BANK = [route.BankEntry(["orders", "open", "how large", "per region"], "12 open orders"),
        route.BankEntry(["supplier", "best", "balance", "orders"], "Supplier 7"),
        route.BankEntry(["part size", "brands"], "Brand 23"),
        route.BankEntry(["late lines", "shipped", "by month"], "March")]
ASKED = {"How large are open orders?": 0, "HOW LARGE ARE OPEN ORDERS?": 0, "open orders per region": 0, "  the supplier with the best balance ": 1, "best supplier": 1,
         "part size of all brands": 2, "shipped late lines by month": 3, "": -1, "   ": -1, "q": -1, "good morning": -1, "orders": -1,
         "best orders of a supplier, open": 1, "brands shipped": -1}
TOLD = "the supplier with the best balance"
TIED = {"orders open, the best": 0}  # two phrases each: the earlier entry


def test_answer_bank(spark):
    asked = {**ASKED, **TIED}
    out = route.bank_lookup(requests(spark, *asked), BANK, "Only sales.").orderBy("request_id").collect()
    assert [r["entry"] for r in out] == list(asked.values())
    assert [r["response"] for r in out] == [BANK[e].response if e >= 0 else "Only sales." for e in asked.values()]


def test_bank_on_whole_texts(spark, data):
    asked = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("request_id"), F.col("text").alias("query"))
    bank = [route.BankEntry(["the", "an", "x"], "a"), route.BankEntry(["ou", "tion", "que les"], "b"), route.BankEntry(["sch", "und "], "c")]
    got = {r["request_id"]: (r["entry"], r["score"]) for r in route.bank_lookup(asked, bank, "no").collect()}
    for r in asked.collect():
        scores = [sum(p in r["query"].lower().strip() for p in e.phrases) for e in bank]
        best = max(range(3), key=lambda i: (scores[i], -i))
        assert got[r["request_id"]] == ((best if scores[best] >= 2 else -1), scores[best]), r["request_id"]


def test_automaton_finds_every_phrase():
    rng = random.Random(2)
    for size, letters in ((60, "ab"), (300, "abcé🙂"), (1, "a")):
        phrases = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(size)} | {"ab" * 90})
        texts = ["", letters[0] * 5000, "x"] + ["".join(rng.choice(letters + "-") for _ in range(rng.randrange(4000))) for _ in range(20)] + ["-" + "ab" * 90 + "-", "z" * 1000 + "ab" * 90]
        want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(phrases) if p in t}
        for most in (20, 1 << 16):
            got = [(int(t), first + int(p)) for first, machine in automaton.automata(phrases, most) for t, p in zip(*machine.found(texts), strict=True)]
            assert set(got) == want and len(got) == len(want)


def test_bank_on_a_question_of_a_megabyte(spark):
    long = "what is this " * 80_000
    asked = requests(spark, long + TOLD, long, TOLD)
    out = route.bank_lookup(asked, BANK, "no").orderBy("request_id").collect()
    alone = 1
    assert [r["entry"] for r in out] == [alone, -1, alone] and [r["score"] for r in out][0] == [r["score"] for r in out][2]


def test_bank_without_entries(spark):
    assert [tuple(r) for r in route.bank_lookup(requests(spark, "a"), [], "no").collect()] == [(0, -1, 0, False, "no")]


def test_scope(spark):
    df = spark.createDataFrame([(1, "acme", "salary of Bob"), (2, "other", "salary of Bob"), (3, "acme", "sales"), (4, None, None)], "request_id int, tenant_id string, query string")
    out = policy.check_scope(df, [policy.ScopeRule("sales", True), policy.ScopeRule("sal", False, "no pay data", "acme")])
    assert sorted(rows(out.select("request_id", "in_scope", "rejection"))) == [(1, False, "no pay data"), (2, True, None), (3, True, None), (4, True, None)]
    assert rows(policy.rejected_results(out)) == [(1, "no pay data", 0, 0.0, True)]


def test_filter_order_and_block(spark):
    df = spark.createDataFrame([("a b",), ("secret b",), ("c",)], "response string").coalesce(1)
    filters = [policy.ResponseFilter(2, rewrite=lambda c: F.replace(c, F.lit("A"), F.lit("X"))), policy.ResponseFilter(1, rewrite=F.upper),
               policy.ResponseFilter(3, block_if=lambda c: c.contains("SECRET"), reason="secret"), policy.ResponseFilter(4, block_if=lambda c: c.contains("C"), reason="c")]
    assert [r["response"] for r in policy.apply_filters(df, filters).collect()] == ["X B", "Response blocked: secret", "Response blocked: c"]
    assert [r["response"] for r in policy.apply_filters(df, []).collect()] == ["a b", "secret b", "c"]


def test_redaction(spark):
    df = spark.createDataFrame([("mail a.b@c.org, call +1 (743) 555-3824, card 4785 3805 9239 1139.",), ("nothing 12 @",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(policy.redact("t")).collect()] == ["mail [EMAIL], call [PHONE], card [CARD].", "nothing 12 @"]
