"""Routing, scope and filters on the given conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.functions.text import quality_score, tokens
from guardedlake.operators import policy, route
from guardedlake.plans.registry import named
from guardedlake.sources.tables import Tables

AGENTS = [
    route.Agent("english", ["The", "of", "and", "in", "to", "is", "on", "it"]),
    route.Agent("french", ["le", "la", "de", "des", "les", "un", "que", "ou"]),
    route.Agent("german", ["der", "die", "das", "und", "nicht", "ein", "ist"]),
    route.Agent("spanish", ["el", "los", "las", "que", "por", "con", "una"]),
    route.Agent("resting", ["the", "le", "der", "el"], healthy=False),
]
THRESHOLD = 0.12


def requests(spark, folder):
    return Tables(spark, folder).spread("conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), F.col("text").alias("query"),
        F.concat(F.lit("tenant-"), (F.col("conv_id") % 3).cast("string")).alias("tenant_id"), "conv_id", "turn", "role")


_REQUESTS_SQL = """
WITH requests AS (SELECT conv_id || '-' || turn AS request_id, text AS query, 'tenant-' || (conv_id % 3) AS tenant_id, conv_id, turn, role FROM conversations),
words AS (SELECT request_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^A-Za-z0-9_]+'), lambda w: length(w) > 1)) AS w FROM requests)
"""


def _agent_rows(healthy_only):
    kept = [a for a in AGENTS if a.healthy or not healthy_only]
    return ", ".join("('{}', [{}])".format(a.name, ", ".join(f"'{k.lower()}'" for k in a.keywords)) for a in kept)


def _scores_sql(healthy_only):
    return _REQUESTS_SQL + f""",
agents(agent, keywords) AS (VALUES {_agent_rows(healthy_only)}),
scores AS (SELECT * FROM (SELECT request_id, agent, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, keywords)) / len(w) END AS score
  FROM words CROSS JOIN agents) WHERE score > 0)
"""


@named("d01_tokens", _REQUESTS_SQL + "SELECT request_id, array_to_string(list_sort(w), ' ') AS words FROM words")
def d01(spark, folder):
    return requests(spark, folder).select("request_id", F.array_join(F.array_sort(tokens("query")), " ").alias("words"))


@named("d02_keyword_scores", _scores_sql(False) + "SELECT request_id, agent, score FROM scores")
def d02(spark, folder):
    return route.keyword_scores(requests(spark, folder), AGENTS)


_ROUTES_SQL = _scores_sql(True) + f""",
best AS (SELECT request_id, max(score) AS top, arg_max(agent, (score, -ascii(agent))) AS name,
  string_agg(agent, ',' ORDER BY score DESC, agent) FILTER (score >= {THRESHOLD}) AS sure FROM scores GROUP BY 1)
"""


@named("d03_routes", _ROUTES_SQL + f"""
SELECT r.request_id, CASE WHEN top >= {THRESHOLD} THEN sure WHEN top IS NOT NULL THEN name ELSE '' END AS targets, coalesce(top, 0) AS confidence,
  CASE WHEN top >= {THRESHOLD} THEN 'Keyword match' WHEN top IS NOT NULL THEN 'Best keyword match (below threshold, no LLM available)'
    ELSE 'No matching agents found and no LLM available' END AS reasoning, NOT coalesce(top >= {THRESHOLD}, false) AS fallback
FROM requests r LEFT JOIN best b ON b.request_id = r.request_id""")
def d03(spark, folder):
    out = route.route(requests(spark, folder), AGENTS, threshold=THRESHOLD)
    return out.withColumn("targets", F.array_join("targets", ","))


def replies(spark, folder):
    """What a model may have said: whole texts with a decision behind them, none, or no reply."""
    r = requests(spark, folder)
    name = F.when(F.col("turn") % 4 == 1, "german").otherwise("french")
    said = F.concat("query", F.lit(' {"agents": ["'), name, F.lit('", "ghost-'), F.col("conv_id").cast("string"),
                    F.lit('", "english"], "reasoning": "about '), F.col("conv_id").cast("string"), F.lit('"}'))
    return r.select("request_id", F.when(F.col("role") == "assistant", said).when(F.col("role") == "user", F.col("query")).alias("reply"))


_REPLIES_SQL = _ROUTES_SQL + """,
replies AS (SELECT request_id, CASE WHEN role = 'assistant' THEN query || ' {"agents": ["' || CASE WHEN turn % 4 = 1 THEN 'german' ELSE 'french' END
  || '", "ghost-' || conv_id || '", "english"], "reasoning": "about ' || conv_id || '"}' WHEN role = 'user' THEN query END AS reply FROM requests),
parts AS (SELECT request_id, reply, list_filter(regexp_extract_all(regexp_extract(reply, '"agents"\\s*:\\s*\\[([^\\]]*)\\]', 1), '"([^"]+)"', 1),
    lambda n: n IN ('english', 'french', 'german', 'spanish')) AS names,
  regexp_extract(reply, '"reasoning"\\s*:\\s*"([^"]+)"', 1) AS why FROM replies),
parsed AS (SELECT request_id, array_to_string(coalesce(names, []), ',') AS agents, CASE WHEN len(names) > 0 THEN 0.8 ELSE 0.0 END AS confidence,
  CASE WHEN reply IS NULL THEN 'LLM routing failed: no reply' WHEN why = '' THEN 'LLM classification' ELSE why END AS reasoning, reply IS NULL AS failed FROM parts)
""".replace("\\\\", "\\")


@named("d04_model_replies", _REPLIES_SQL + "SELECT request_id, agents, CAST(confidence AS DOUBLE) AS confidence, reasoning, failed FROM parsed")
def d04(spark, folder):
    out = route.parse_replies(replies(spark, folder), [a.name for a in AGENTS if a.healthy])
    return out.withColumn("agents", F.array_join("agents", ","))


@named("d04_routes_with_replies", _REPLIES_SQL + f"""
SELECT r.request_id, CASE WHEN top >= {THRESHOLD} THEN sure ELSE p.agents END AS targets,
  CASE WHEN top >= {THRESHOLD} THEN top ELSE CAST(p.confidence AS DOUBLE) END AS confidence,
  CASE WHEN top >= {THRESHOLD} THEN 'Keyword match' ELSE p.reasoning END AS reasoning,
  CASE WHEN top >= {THRESHOLD} THEN false ELSE p.failed END AS fallback
FROM requests r LEFT JOIN best b ON b.request_id = r.request_id JOIN parsed p ON p.request_id = r.request_id""")
def d04_routes(spark, folder):
    out = route.route(requests(spark, folder), AGENTS, replies(spark, folder), threshold=THRESHOLD)
    return out.withColumn("targets", F.array_join("targets", ","))


@named("d05_resolved_agents", _REPLIES_SQL + """
, names AS (SELECT request_id, unnest(string_split(agents, ',')) AS agent, unnest(range(len(string_split(agents, ',')))) AS pos FROM parsed WHERE agents <> '')
SELECT request_id, CAST(pos AS INTEGER) AS pos, agent, '' AS error_code FROM names WHERE agent IN ('english', 'french', 'german', 'spanish')
UNION ALL SELECT request_id, -1, '', 'ORCHESTRATION_ERROR' FROM parsed WHERE agents = ''""")
def d05(spark, folder):
    routes = route.parse_replies(replies(spark, folder), [a.name for a in AGENTS]).select("request_id", F.col("agents").alias("targets"))
    found, lost = route.resolve_agents(routes, route.agents_frame(spark, AGENTS))
    return (found.withColumn("error_code", F.lit(""))
            .unionByName(lost.select("request_id", F.lit(-1).alias("pos"), F.lit("").alias("agent"), "error_code")))


@named("d06_agent_catalog", """
WITH last AS (SELECT p_brand AS agent, max(p_partkey) AS k FROM part GROUP BY 1)
SELECT agent, '## ' || agent || chr(10) || '**Description:** ' || p_name || chr(10) || chr(10) || '**Capabilities:**' || chr(10) || '- **' || lower(p_type)
  || '**: size ' || p_size || chr(10) || chr(10) || '**Keywords:** ' || array_to_string(list_sort(string_split(p_name, ' ')), ', ') || chr(10) || chr(10) AS markdown
FROM last JOIN part ON p_partkey = k""")
def d06(spark, folder):
    cap = F.struct(F.lower("p_type").alias("name"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("description"))
    rows = Tables(spark, folder).part.select(F.col("p_brand").alias("agent"), F.col("p_name").alias("description"), F.array(cap).alias("capabilities"),
                                             F.split("p_name", " ").alias("keywords"), F.col("p_partkey").alias("pos"))
    return route.agent_markdown(route.registered_agents(rows))


BANK = [
    route.BankEntry(["the", " of ", "and "], "An English text."),
    route.BankEntry([" le ", "que", " la ", "ou"], "Un texte."),
    route.BankEntry(["der", "sch", "ung", " die "], "Ein Text."),
    route.BankEntry(["el ", "los", "ado", " que "], "Un texto."),
]


def _bank_score(entry):
    return " + ".join(f"CAST(contains(lower(query), '{p}') AS INTEGER)" for p in entry.phrases)


@named("d07_answer_bank", _REQUESTS_SQL + f"""
, s AS (SELECT request_id, {', '.join(f'{_bank_score(e)} AS s{i}' for i, e in enumerate(BANK))} FROM requests),
b AS (SELECT *, greatest(s0, s1, s2, s3) AS score FROM s),
e AS (SELECT request_id, score, CASE score WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END AS i FROM b)
SELECT request_id, CASE WHEN score >= 2 THEN i ELSE -1 END AS entry, score, score >= 2 AS success, CASE WHEN score < 2 THEN 'Out of scope.' ELSE
  CASE i {' '.join(f"WHEN {i} THEN '{e.response}'" for i, e in enumerate(BANK))} END END AS response FROM e""")
def d07(spark, folder):
    return route.bank_lookup(requests(spark, folder), BANK, "Out of scope.")


@named("d08_quality_scores", r"""
WITH texts AS (SELECT 'd-' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'o-' || o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Quality: 0.' || (o_orderkey % 10) || ' of 1.0' WHEN '2-HIGH' THEN '' || (o_custkey % 12)
    WHEN '3-MEDIUM' THEN 'rated ' || o_totalprice ELSE 'no score' END FROM orders),
found AS (SELECT id, regexp_extract(text, '([0-9]+\.[0-9]+|[01])', 1) AS m FROM texts)
SELECT id, CASE WHEN m = '' THEN 0.5 ELSE greatest(0.0, least(1.0, CAST(m AS DOUBLE))) END AS score FROM found""")
def d08(spark, folder):
    t = Tables(spark, folder)
    p = F.col("o_orderpriority")
    text = (F.when(p == "1-URGENT", F.concat(F.lit("Quality: 0."), (F.col("o_orderkey") % 10).cast("string"), F.lit(" of 1.0")))
            .when(p == "2-HIGH", (F.col("o_custkey") % 12).cast("string"))
            .when(p == "3-MEDIUM", F.concat(F.lit("rated "), F.col("o_totalprice").cast("string"))).otherwise("no score"))
    texts = (t.spread("documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("id"), "text")
             .unionByName(t.orders.select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"), text.alias("text"))))
    return texts.select("id", quality_score("text").alias("score"))


RULES = [
    policy.ScopeRule("(?i)euxai", True),
    policy.ScopeRule("tion", False, "Tenant 1 may not ask this.", "tenant-1"),
    policy.ScopeRule("sch", False, "Not in scope."),
    policy.ScopeRule("(?i)^an", False, "Not at the start."),
]


@named("d09_scope_check", _REQUESTS_SQL + """
, c AS (SELECT *, CASE WHEN regexp_matches(query, '(?i)euxai') THEN 0 WHEN regexp_matches(query, 'tion') AND tenant_id = 'tenant-1' THEN 1
  WHEN regexp_matches(query, 'sch') THEN 2 WHEN regexp_matches(query, '(?i)^an') THEN 3 ELSE 4 END AS rule FROM requests)
SELECT request_id, rule IN (0, 4) AS in_scope, CASE rule WHEN 1 THEN 'Tenant 1 may not ask this.' WHEN 2 THEN 'Not in scope.' WHEN 3 THEN 'Not at the start.' END AS rejection FROM c""")
def d09(spark, folder):
    return policy.check_scope(requests(spark, folder), RULES).select("request_id", "in_scope", "rejection")


@named("d09_rejected_results", _REQUESTS_SQL + """
SELECT request_id, 'Not in scope.' AS response, 0 AS iterations, CAST(0 AS DOUBLE) AS quality_score, true AS rejected FROM requests WHERE regexp_matches(query, 'sch')""")
def d09_rejected(spark, folder):
    return policy.rejected_results(policy.check_scope(requests(spark, folder), [policy.ScopeRule("sch", False, "Not in scope.")]))


def _redact_sql(col):
    out = col
    for pattern, tag in ((policy.EMAIL, "EMAIL"), (policy.CARD, "CARD"), (policy.PHONE, "PHONE")):
        out = f"regexp_replace({out}, '{pattern}', '[{tag}]', 'g')"
    return out


FILTERS = [
    policy.ResponseFilter(5, rewrite=lambda c: F.replace(c, F.lit("the"), F.lit("THE"))),
    policy.ResponseFilter(1, block_if=lambda c: c.rlike("[0-9]{16}"), reason="card number"),
    policy.redaction_filter(2),
    policy.ResponseFilter(3, block_if=lambda c: c.contains("[EMAIL]"), reason="contact data"),
]


@named("d10_response_filters", f"""
WITH r AS (SELECT doc_id, text, {_redact_sql('text')} AS clean FROM documents),
s AS (SELECT doc_id, clean, CASE WHEN regexp_matches(text, '[0-9]{{16}}') THEN 'card number' WHEN contains(clean, '[EMAIL]') THEN 'contact data' END AS reason FROM r)
SELECT doc_id, reason IS NOT NULL AS blocked, md5(CASE WHEN reason IS NULL THEN replace(clean, 'the', 'THE') ELSE 'Response blocked: ' || reason END) AS digest FROM s""")
def d10(spark, folder):
    out = policy.apply_filters(Tables(spark, folder).spread("documents").select("doc_id", F.col("text").alias("response")), FILTERS)
    return out.select("doc_id", "blocked", F.md5(F.col("response").cast("binary")).alias("digest"))


@named("d11_redaction", f"""
SELECT 'd-' || doc_id AS id, length({_redact_sql('text')}) AS n_chars, md5({_redact_sql('text')}) AS digest FROM documents
UNION ALL SELECT 'c-' || conv_id || '-' || turn, length({_redact_sql('text')}), md5({_redact_sql('text')}) FROM conversations""")
def d11(spark, folder):
    t = Tables(spark, folder)
    texts = (t.spread("documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("id"), "text")
             .unionByName(t.conversations.select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")))
    clean = texts.select("id", policy.redact("text").alias("text"))
    return clean.select("id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))
