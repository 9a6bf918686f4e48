import random

from pyspark.sql import functions as F

from guardedlake.functions.text import quality_score
from guardedlake.operators import policy, refine, route
from guardedlake.plans import answer as qa
from tests.conftest import rows

LOG = ("request_id int, iteration int, pos int, agent string, plan string, success boolean, response string, error string, score_text string, elapsed_ms bigint")


def python_loop(log, threshold=0.7, limit=5):
    """The loop itself, one request at a time."""
    out = {}
    for rid in sorted({r[0] for r in log}):
        mine, iterations, score, used, texts, by = [r for r in log if r[0] == rid], 0, 0.0, [], [], "max"
        for n in range(1, min(limit, max(r[1] for r in mine)) + 1):
            now = sorted((r for r in mine if r[1] == n), key=lambda r: r[2])
            iterations = n
            if n > 1 and (now[0][4] is None or now[0][4].strip().upper() == "COMPLETE"):
                by = "complete"
                break
            for r in now:
                if r[5]:
                    texts.append(r[6])
                    if r[3] not in used:
                        used.append(r[3])
            if not any(t and t.strip() for t in texts):
                score = 0.0
            else:
                score = 0.5 if now[0][8] is None else min(1.0, float(now[0][8]))
            if score >= threshold:
                by = "threshold"
                break
        out[rid] = (iterations, by, score, used)
    return out


def test_replay_equals_the_loop(spark):
    rnd, log = random.Random(5), []
    for rid in range(120):
        for n in range(1, rnd.randint(1, 7) + 1):
            plan = rnd.choice(["more", "more", "more", " complete", "COMPLETE\n", None])
            score = rnd.choice(["0.1", "0.69", "0.7", "0.95", "2.5", None, "0.3", "0.2"])
            for pos, agent in enumerate(rnd.sample(["a", "b", "c"], rnd.randint(1, 3))):
                ok = rnd.random() < 0.6
                log.append((rid, n, pos, agent, plan, ok, rnd.choice(["text", " "]) if ok else None, None if ok else "e", score, 1))
    got = {r["request_id"]: (r["iterations"], r["stopped_by"], r["quality_score"], r["agents_used"])
           for r in refine.replay(spark.createDataFrame(log, LOG)).collect()}
    assert got == python_loop(log)


def test_refine_stops_each_request_on_its_own(spark):
    calls = []

    def step(df, n):
        calls.append(n)
        return df.withColumn("response", F.concat(F.lit("0."), (F.col("request_id") + n * 2).cast("string")))

    req = spark.createDataFrame([(1,), (5,), (0,)], "request_id int")
    out = refine.refine(req, step, lambda d: d.withColumn("quality_score", quality_score("response")), max_rounds=3)
    assert sorted(rows(out.select("request_id", "iterations", "response"))) == [(0, 3, "0.6"), (1, 3, "0.7"), (5, 1, "0.7")]
    assert calls == [1, 2, 3]
    calls.clear()
    refine.refine(req.where("request_id = 5"), step, lambda d: d.withColumn("quality_score", quality_score("response")))
    assert calls == [1]


def log_of(spark, *items):
    return spark.createDataFrame([(r, i, p, a, None, ok, t if ok else None, None if ok else t, None, ms) for r, i, p, a, ok, t, ms in items], LOG)


def test_consolidation(spark):
    log = log_of(spark, (1, 1, 0, "a", True, "one", 1), (2, 1, 0, "a", False, "x", 1), (2, 1, 1, "b", False, "y", 1), (3, 2, 0, "a", True, "late", 1),
                 (3, 1, 0, "b", True, "early", 1), (4, 1, 0, "a", False, "z", 1), (4, 1, 1, "b", True, "only", 1), (6, 1, 0, "a", True, "p", 1), (6, 1, 1, "b", True, "q", 1))
    req = spark.createDataFrame([(i,) for i in range(1, 7)], "request_id int")
    merged = spark.createDataFrame([(6, "both"), (1, "unused")], "request_id int, merged string")
    got = dict(rows(refine.consolidate(req, log, merged)))
    assert got == {1: "one", 2: "All agents failed to process your query:\n- a: x\n- b: y", 3: "**b:**\nearly\n\n---\n\n**a:**\nlate", 4: "only",
                   5: "No responses were generated for your query.", 6: "both"}
    assert dict(rows(refine.observation_summary(log)))[3] == "[b]: early\n[a]: late"


def test_timeouts_and_single_shot(spark):
    log = refine.apply_timeout(log_of(spark, (1, 1, 0, "a", True, "ok", 30_000), (2, 1, 0, "a", True, "slow", 30_001), (3, 1, 0, "a", False, "boom", 5)))
    assert sorted(rows(log.select("request_id", "success", "response", "error"))) == [
        (1, True, "ok", None), (2, False, None, "Agent timed out after 30s"), (3, False, None, "Agent execution failed: boom")]
    routed = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (4, 0, "z")], "request_id int, pos int, agent string")
    got = {r[0]: tuple(r)[1:] for r in refine.single_shot(routed, log).collect()}
    assert got == {1: ("ok", "a", 1, 1.0), 2: ("Agent timed out after 30s", "", 1, 1.0), 4: ("No response from agent", "", 1, 1.0)}


def test_question_to_answer(spark):
    agents = [route.Agent("sql", ["sales", "table"]), route.Agent("docs", ["manual"])]
    req = spark.createDataFrame([("1", "acme", None, None, "sales table"), ("2", "acme", "u", "s", " "), ("3", "acme", "u", "s", "secret sales"),
                                 ("4", None, "u", "s", "weather today"), ("5", "acme", "u", "s", "manual")],
                                "request_id string, tenant_id string, user_id string, session_id string, query string")
    asked = []

    def act(calls, n):
        asked.append(n)
        ok = F.col("agent") == "sql"
        return (calls.withColumn("success", ok).withColumn("response", F.when(ok, F.lit(f"mail x@y.org {n}"))).withColumn("error", F.when(~ok, "down"))
                .withColumn("elapsed_ms", F.lit(1)))

    user = qa.Round(act, score=lambda d, n: d.withColumn("score_text", F.lit("0.3")),
                    plan=lambda d, n: d.withColumn("plan", F.when(F.col("summary").contains("x@y.org 2"), "complete").otherwise("more")))
    rules = [policy.ScopeRule("secret", False, "Not that.")]
    out = {r["request_id"]: r for r in qa.answer(req, agents, user, None, rules, [policy.redaction_filter()], max_rounds=4).collect()}
    assert (out["1"]["response"], out["1"]["iterations"], out["1"]["agents_used"], out["1"]["quality_score"]) == (
        "**sql:**\nmail [EMAIL] 1\n\n---\n\n**sql:**\nmail [EMAIL] 2", 3, ["sql"], 0.3)
    assert (out["2"]["status"], out["2"]["response"]) == ("invalid", "Query must not be blank")
    assert (out["3"]["status"], out["3"]["response"]) == ("rejected", "Not that.")
    assert (out["4"]["status"], out["4"]["response"]) == ("error", "Routing found no suitable agents for query: weather today")
    assert (out["1"]["confidence"], out["1"]["reasoning"]) == (1.0, "Keyword match")
    assert (out["5"]["iterations"], out["5"]["quality_score"], out["5"]["agents_used"]) == (4, 0.0, [])
    assert out["5"]["response"].startswith("All agents failed to process your query:\n- docs: Agent execution failed: down")
    assert asked == [1, 2, 3, 4]
    shot = {r["request_id"]: r for r in qa.answer(req, agents, user, None, rules, single_shot=True).collect()}
    assert (shot["1"]["response"], shot["1"]["iterations"], shot["1"]["quality_score"]) == ("mail x@y.org 1", 1, 1.0)
    assert (shot["5"]["response"], shot["5"]["agents_used"]) == ("Agent execution failed: down", [])


def test_rounds_see_what_was_observed(spark):
    """The score reads this round's observations, agents the plan and the history, and no agent is an error of its own."""
    agents = [route.Agent("sql", ["sales"])]
    req = spark.createDataFrame([("1", "acme", "u", "s", "sales", 4)], "request_id string, tenant_id string, user_id string, session_id string, query string, turn int")
    said = spark.createDataFrame([("acme:s", i, "USER", f"m{i}") for i in range(30)], "session_key string, seq int, role string, content string")

    def act(calls, n):
        text = F.concat_ws("/", F.lit(f"try {n}"), "plan", F.size("history").cast("string"), F.element_at("history", -1)["content"])
        return calls.withColumn("success", F.lit(True)).withColumn("response", text).withColumn("error", F.lit(None).cast("string")).withColumn("elapsed_ms", F.lit(1))

    user = qa.Round(act, score=lambda d, n: d.withColumn("score_text", F.when(F.col("summary").contains("try 3"), "0.9").otherwise("0.1")),
                    plan=lambda d, n: d.withColumn("plan", F.concat(F.lit("after "), "summary")))
    out = qa.answer(req, agents, user, messages=said)
    row = out.first()
    assert (row["iterations"], row["quality_score"]) == (3, 0.9)
    assert "try 2/after [sql]: try 1/20/m29/20/m29" in row["response"]
    assert sorted(tuple(r)[1:3] for r in qa.exchanges(req, out).collect()) == [(8, "USER"), (9, "ASSISTANT")]
    idle = qa.answer(req, [route.Agent("sql", ["sales"], healthy=False)], user).first()
    assert (idle["status"], idle["response"]) == ("error", "No healthy agents available")
