"""SQL screening, bounded results and the statement profile on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.functions.text import markdown_line
from guardedlake.operators import bounded, guard
from guardedlake.plans.registry import named
from guardedlake.sources.tables import Tables


def statements(spark, folder):
    """A statement for every order, and every document's whole text taken as one."""
    t, k = Tables(spark, folder), F.col("o_orderkey").cast("string")
    p = F.col("o_orderpriority")
    sql = (F.when(p == "1-URGENT", F.concat(F.lit("DELETE FROM orders WHERE o_orderkey = "), k))
           .when(p == "2-HIGH", F.concat(F.lit("select o_custkey, \"o\" from orders where o_orderkey = "), k, F.lit(" order  by 1;;  ")))
           .when(p == "3-MEDIUM", F.concat(F.lit("SELECT 'DELETE failed' AS note, count(*) FROM orders GROUP BY o_custkey HAVING COUNT(*) > "), k))
           .when(p == "5-LOW", F.concat(F.when(F.col("o_orderstatus") == "F", "SET search_path TO s_").otherwise("set role admin_"), k))
           .otherwise(F.concat(F.lit("WITH x AS (update orders set o_totalprice = 9.99 where o_orderkey = "), k, F.lit(") SELECT * FROM x"))))
    return (t.spread("orders").select(F.concat(F.lit("o-"), k).alias("statement_id"), sql.alias("sql"))
            .unionByName(t.spread("documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("statement_id"), F.col("text").alias("sql"))))


_STATEMENTS_SQL = """
WITH statements AS (
  SELECT 'o-' || o_orderkey AS statement_id, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'DELETE FROM orders WHERE o_orderkey = ' || o_orderkey
    WHEN '2-HIGH' THEN 'select o_custkey, "o" from orders where o_orderkey = ' || o_orderkey || ' order  by 1;;  '
    WHEN '3-MEDIUM' THEN 'SELECT ''DELETE failed'' AS note, count(*) FROM orders GROUP BY o_custkey HAVING COUNT(*) > ' || o_orderkey
    WHEN '5-LOW' THEN (CASE WHEN o_orderstatus = 'F' THEN 'SET search_path TO s_' ELSE 'set role admin_' END) || o_orderkey
    ELSE 'WITH x AS (update orders set o_totalprice = 9.99 where o_orderkey = ' || o_orderkey || ') SELECT * FROM x' END AS sql FROM orders
  UNION ALL SELECT 'd-' || doc_id, text FROM documents)
"""
_WORDS = "|".join(guard.UNSAFE_WORDS)
_SCREEN_SQL = _STATEMENTS_SQL + rf""",
cleaned AS (SELECT statement_id, regexp_replace(sql, '[\s;]+$', '') AS sanitized FROM statements),
bare AS (SELECT *, regexp_replace(sanitized, '''([^'']|'''')*''', '', 'g') AS b FROM cleaned),
found AS (SELECT statement_id, sanitized, upper(regexp_extract(b, '(?i)\b({_WORDS})\b', 1)) AS kw,
  regexp_matches(regexp_replace(b, '(?i)\bSET\s+search_path\b', ' ', 'g'), '(?i)\bSET\b') AS sets FROM bare),
screened AS (SELECT statement_id, sanitized, CASE WHEN kw <> '' THEN kw WHEN sets THEN 'SET' ELSE '' END AS keyword FROM found)
"""


@named("c01_sql_screen", _SCREEN_SQL + """
SELECT statement_id, md5(sanitized) AS digest, keyword = '' AS allowed, keyword,
  CASE WHEN keyword <> '' THEN 'SQL_EXECUTION_ERROR' END AS error_code,
  CASE WHEN keyword <> '' THEN 'Unsafe SQL operation detected: ' || keyword || '. Only SELECT queries are allowed.' END AS message FROM screened""")
def c01(spark, folder):
    out = guard.screen(statements(spark, folder))
    return out.select("statement_id", F.md5(F.col("sanitized").cast("binary")).alias("digest"), "allowed", "keyword", "error_code", "message")


_GUARDED = """
SELECT n_name AS unit, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE l_returnflag = 'R' GROUP BY n_name"""


@named("c02_guarded_sql", _GUARDED)
def c02(spark, folder):
    Tables(spark, folder).register(["lineitem", "supplier", "nation"])
    refused = guard.guarded_sql(spark, "DELETE FROM lineitem")
    answer = guard.guarded_sql(spark, _GUARDED + " ; ")
    if answer.error or not refused.error:
        raise RuntimeError(answer.error or "a DELETE was let through")
    return answer.result


@named("c03_row_cap", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def c03(spark, folder):
    orders = Tables(spark, folder).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return bounded.cap_rows(orders, 50, [F.desc("o_totalprice"), F.col("o_orderkey")])


@named("c04_column_cap", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def c04(spark, folder):
    return bounded.cap_columns(Tables(spark, folder).orders, 4)


_CELL = "CASE WHEN length({0}) > 200 THEN substring({0}, 1, 200) || '...[' || (length({0}) - 200) || ' more]' ELSE {0} END"


@named("c05_cell_text", f"""
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, {_CELL.format('text')} AS text, coalesce(CAST(quality AS VARCHAR), 'NULL') AS quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def c05(spark, folder):
    t = Tables(spark, folder)
    return bounded.cells(t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id", "left"))


@named("c06_markdown_lines", """
SELECT c_custkey, '| ' || c_custkey || ' | ' || c_name || ' | ' || c_acctbal || ' | ' || c_mktsegment || ' | ' AS line FROM customer""")
def c06(spark, folder):
    c = Tables(spark, folder).customer
    shown = bounded.cells(c.select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal", "c_mktsegment"))
    return shown.select(F.col("k").cast("bigint").alias("c_custkey"), markdown_line([F.col(x) for x in shown.columns]).alias("line"))


_CAPS = bounded.Caps(output_chars=4_000)
_LINES_SQL = f"""
WITH lines AS (SELECT source AS result_id, doc_id AS pos,
  '| ' || doc_id || ' | ' || lang || ' | ' || {_CELL.format('text')} || ' | ' AS line FROM documents),
capped AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY pos) AS n FROM lines),
budget AS (SELECT *, n = 1 OR 47 + sum(length(line) + 1) OVER (PARTITION BY result_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 4000 AS shown
  FROM capped WHERE n <= 50)
"""
_HEADER = bounded.header_text(["doc_id", "lang", "text"])


def document_lines(spark, folder):
    docs = Tables(spark, folder).documents
    shown = bounded.cells(docs.select("doc_id", "lang", "text", "source"))
    return shown.select(F.col("source").alias("result_id"), F.col("doc_id").cast("bigint").alias("pos"),
                        markdown_line([F.col("doc_id"), F.col("lang"), F.col("text")]).alias("line"))


@named("c07_output_budget", _LINES_SQL.replace("47", str(len(_HEADER))) + "SELECT result_id, pos, CAST(n AS INTEGER) AS n, shown FROM budget")
def c07(spark, folder):
    return bounded.within_budget(document_lines(spark, folder), len(_HEADER), _CAPS).drop("line")


@named("c08_result_markdown", _LINES_SQL.replace("47", str(len(_HEADER))) + f""",
sums AS (SELECT result_id, count(*) AS row_count, count(*) FILTER (shown) AS k, {len(_HEADER)} + sum(length(line) + 1) FILTER (shown) > 4000 AS truncated,
  string_agg(line || chr(10), '' ORDER BY n) FILTER (shown) AS body FROM budget GROUP BY result_id)
SELECT result_id, row_count, truncated, row_count >= 50 AS limit_reached,
  '| doc_id | lang | text | ' || chr(10) || '| --- | --- | --- | ' || chr(10) || body
  || CASE WHEN truncated THEN chr(10) || '... (output truncated, showing ' || k || ' of ' || row_count || ' rows)' || chr(10) ELSE '' END
  || chr(10) || '_' || row_count || ' row(s) returned' || CASE WHEN row_count >= 50 THEN ' (limit reached)' ELSE '' END || '_' AS markdown FROM sums""")
def c08(spark, folder):
    return bounded.render(document_lines(spark, folder), _HEADER, _CAPS)


_PROFILE = "|".join(w.replace(" ", r"\s+") for w in sorted(guard.PROFILE_WORDS, key=lambda w: (-len(w), w)))
_TOKENS_SQL = _STATEMENTS_SQL + rf""",
toks AS (SELECT statement_id, unnest(regexp_extract_all(sql, '(?i)''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"|\b(?:{_PROFILE})\b|\b[0-9]+(?:\.[0-9]+)?\b')) AS t FROM statements)
"""


@named("c09_statement_profile", _TOKENS_SQL + """
SELECT s.statement_id, count(t) FILTER (regexp_matches(t, '^[''"]')) AS n_literals, count(t) FILTER (regexp_matches(t, '^[A-Za-z]')) AS n_keywords,
  count(t) FILTER (regexp_matches(t, '^[0-9]')) AS n_numbers FROM statements s LEFT JOIN toks ON toks.statement_id = s.statement_id GROUP BY 1""")
def c09(spark, folder):
    return guard.statement_profile(statements(spark, folder)).drop("sql")


@named("c09_keyword_frequency", _TOKENS_SQL + r"""
SELECT upper(regexp_replace(t, '\s+', ' ', 'g')) AS keyword, count(*) AS n FROM toks WHERE regexp_matches(t, '^[A-Za-z]') GROUP BY 1""")
def c09_frequency(spark, folder):
    return guard.keyword_frequency(statements(spark, folder))
