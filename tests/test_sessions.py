import random

from pyspark.sql import functions as F

from guardedlake.functions.ordered import ordered_text, running_total
from guardedlake.operators import feed, metrics, quality, sessions
from tests.conftest import plan, rows


def test_validation(spark):
    df = spark.createDataFrame([(1, " ", None), (2, "q" * 10_000, "s" * 100), (3, "q" * 10_001, "s" * 101), (4, None, "s")], "request_id int, query string, session_id string")
    out = sessions.validate(df.withColumn("options", F.lit(None).cast("map<string,string>")))
    assert {r[0]: (r[1], r[2]) for r in out.select("request_id", "valid", "violations").collect()} == {
        1: (False, [sessions.BLANK_QUERY]), 2: (True, []), 3: (False, [sessions.LONG_QUERY, sessions.LONG_SESSION]), 4: (False, [sessions.BLANK_QUERY])}
    assert out.first()["options"] == {}


def test_tenants_stay_apart(spark):
    df = spark.createDataFrame([("1", "acme", "sess-123"), ("2", "other", "sess-123"), ("3", None, "sess-456"), ("4", "acme", None)], "request_id string, tenant_id string, session_id string")
    out = sessions.scoped_keys(df.withColumn("user_id", F.lit(None).cast("string"))).orderBy("request_id").collect()
    assert [r["session_key"] for r in out[:3]] == ["acme:sess-123", "other:sess-123", "default:sess-456"]
    assert len(out[3]["session_key"]) == len("acme:") + 64 and out[0]["user_id"] == "anonymous"


def test_no_writer_is_lost(spark):
    writers = [spark.createDataFrame([("k", w * 100 + i, "USER", f"{w}-{i}") for i in range(10)], "session_key string, seq bigint, role string, content string") for w in range(5)]
    assert sessions.merge_writers(*writers, keep=1000).count() == 50
    assert sorted(r["seq"] for r in sessions.merge_writers(*writers, keep=3).collect()) == [407, 408, 409]


def test_history_is_cut_before_the_shuffle(spark):
    m = spark.range(100).select((F.col("id") % 3).alias("session_key"), F.col("id").alias("seq"), F.lit("USER").alias("role"), F.lit("x").alias("content"))
    text = plan(sessions.trimmed_history(m, 20))
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit")


def test_idle_sessions_equal_a_scan(spark):
    rnd, data = random.Random(2), []
    for key in range(6):
        t = 1_700_000_000
        for _ in range(120):
            t += rnd.choice([0, 1, 60, 1799, 1800, 1801, 4000])
            data.append((key, t))
    expect = []
    for key in range(6):
        times, current = sorted(t for k, t in data if k == key), []
        for t in times:
            if current and t - current[-1] >= 1800:
                expect.append((key, current[0], current[-1], len(current)))
                current = []
            current.append(t)
        expect.append((key, current[0], current[-1], len(current)))
    df = spark.createDataFrame(data, "session_key int, s bigint").select("session_key", F.timestamp_seconds("s").alias("ts"))
    got = [(r[0], int(r[1]), int(r[2]), r[3]) for r in sessions.idle_sessions(df).select(
        "session_key", F.unix_seconds("started"), F.unix_seconds("last_access"), "n").collect()]
    assert sorted(got) == sorted(expect)


def test_session_cap_is_a_topk(spark):
    df = spark.range(50).select(F.col("id").alias("session_key"), F.timestamp_seconds("id").alias("last_access"))
    assert "TakeOrderedAndProject" in plan(sessions.cap_sessions(df, 5))


def test_event_lines(spark):
    text = ["event: progress", 'data: {"a": 1}', "", "data: lost", "", "event:data", "data: one", "data: two ", "", ": note", "event: done", "data: {}", "", "event: open", "data: 1"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)] + [("g", 0, "event: x"), ("g", 1, "data: y"), ("g", 2, "")], "file string, line_no int, line string")
    for span in (1, 2, 5, 1000):
        got = sorted((r["file"], r["event_no"], r["type"], r["payload"]) for r in feed.parse_events(df, span=span).collect())
        assert got == [("f", 0, "progress", '{"a": 1}'), ("f", 5, "data", "two"), ("f", 9, "done", "{}"), ("g", 0, "x", "y")]


def fold_message(events):
    content, complete = "", False
    for _, kind, text in sorted(events):
        if kind == "data":
            content += text
        elif kind == "error":
            content = f"Error: {text}"
        else:
            complete = True
    return content, complete


def test_message_reduction_equals_a_fold(spark):
    rnd, data = random.Random(4), []
    for m in range(40):
        for seq in range(rnd.randint(1, 30)):
            kind = rnd.choices(["data", "error", "done"], [20, 1, 1])[0]
            data.append((m, seq, kind, f"t{seq} " if kind != "done" else ""))
    data += [(99, 0, "data", "Hello "), (99, 1, "data", "world"), (98, 0, "error", "timeout")]
    got = {r[0]: (r[1], r[2]) for r in feed.reduce_messages(spark.createDataFrame(data, "message_id int, seq int, type string, text string")).collect()}
    assert got == {m: fold_message([d[1:] for d in data if d[0] == m]) for m in {d[0] for d in data}}
    assert got[99] == ("Hello world", False) and got[98] == ("Error: timeout", False)


def fold_steps(events):
    steps = []
    for _, step, detail in sorted(events):
        known = [s for s in steps if s[0] == step]
        if known:
            known[0][1:] = ["active", detail]
        else:
            for s in steps:
                s[1] = "done"
            steps.append([step, "active", detail])
    return [(s[0], i + 1, s[1], s[2]) for i, s in enumerate(steps)]


def test_step_states_equal_a_fold(spark):
    rnd = random.Random(6)
    data = [(r, seq, rnd.choice(["rag", "sql", "execute", "format"]), f"d{seq}") for r in range(60) for seq in range(rnd.randint(1, 9))]
    got = sorted(rows(feed.step_states(spark.createDataFrame(data, "request_id int, seq int, step string, detail string"))))
    assert got == sorted((r, *s) for r in range(60) for s in fold_steps([d[1:] for d in data if d[0] == r]))


def test_two_level_scans(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("o"), F.concat(F.lit("t"), "id").alias("t"))
    total = running_total(df, ["k"], "o", F.lit(1), "n", span=17)
    assert all(r["n"] == r["o"] // 3 + 1 for r in total.collect())
    text = {r["k"]: r["x"] for r in ordered_text(df, ["k"], "o", "t", "x", ",", span=17).collect()}
    assert text == {k: ",".join(f"t{i}" for i in range(k, 1000, 3)) for k in range(3)}


def test_latency_quantiles_are_exact(spark):
    rnd = random.Random(8)
    values = [rnd.randint(1, 500) for _ in range(997)]
    out = metrics.latency_summary(spark.createDataFrame([("a", v) for v in values], "g string, latency_ms bigint"), ["g"]).first()
    s = sorted(values)
    assert (out["p50_ms"], out["p95_ms"], out["p99_ms"], out["max_ms"], out["query_count"]) == (s[498], s[947], s[987], s[-1], 997)


def test_health(spark):
    agents = spark.createDataFrame([("a", True), ("b", False)], "agent string, healthy boolean")
    active = spark.createDataFrame([("k",), ("k",), ("l",)], "session_key string")
    assert rows(metrics.health(agents, sessions.active_count(active))) == [("UP", 2, 1, 2)]
    assert metrics.health(agents.where("false"), sessions.active_count(active)).first()["status"] == "DOWN"


def test_audit(spark):
    df = spark.createDataFrame([(1, None, "A"), (1, 5, "B"), (2, 5, None), (None, 6, "toolong")], "id int, parent int, kind string")
    out = quality.audit(quality.audit_rows("t", df, [quality.not_null("parent"), quality.one_of("kind", ["A", "B"]), quality.max_length("kind", 3)]),
                        quality.audit_unique("t", df, ["id"]), quality.audit_foreign_key("t", df, "parent", df, "id"))
    assert {r["rule"]: r["violations"] for r in out.collect()} == {
        "not_null(parent)": 1, "check(kind)": 1, "length(kind)": 1, "unique(id)": 1, "foreign_key(parent)": 3}


def test_lines_of_log_files_do_not_carry_their_path(spark, data):
    from guardedlake.plans.all_queries import NAMED

    df = NAMED["f09_log_files"].run(spark, data)
    window = [line for line in plan(df).split("== Physical Plan ==")[-1].splitlines() if " Window [" in line and "line_no" in line]
    assert window and not any("file#" in line for line in window)
