"""Screening of SQL text, and running what passes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardedlake.functions.text import WHITE_SPACE, ascii_word, is_blank

# Words that make a statement unsafe, and the texts it is refused with.
UNSAFE_WORDS = ["INSERT", "UPDATE", "DELETE", "TRUNCATE", "DROP", "ALTER", "CREATE", "MERGE", "REPLACE", "GRANT",
                "REVOKE", "COPY", "CALL", "DO", "EXECUTE", "PREPARE", "LISTEN", "NOTIFY", "VACUUM", "REINDEX"]
EMPTY_MESSAGE = "SQL statement cannot be null or empty"
UNSAFE_MESSAGE = "Unsafe SQL operation detected: {}. Only SELECT queries are allowed."
ERROR_CODE = "SQL_EXECUTION_ERROR"

# Spark runs commands as soon as they are parsed, so beyond the word list only
# statements that begin like a read are let through.
READ_WORDS = ["SELECT", "WITH", "VALUES", "TABLE", "FROM", "EXPLAIN", "DESCRIBE", "DESC", "SHOW"]
# Commands that only tell something; all other commands are refused by their place in the parsed plan.
READ_COMMANDS = ("Show", "Describe", "Explain")
CATALYST = "org.apache.spark.sql.catalyst"
# Functions that call the JVM by name, and those that name the files behind a table.
UNSAFE_FUNCTIONS = {"reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start", "input_file_block_length"}
BUILT_IN_SCHEMAS = (["builtin"], ["system", "builtin"])

# Both start with a character that ends a word before them, so the text is searched with a blank
# in front; the look-ahead for a first letter is cheaper than trying every word.
_FIRST = "".join(sorted({c for w in UNSAFE_WORDS for c in (w[0], w[0].lower())}))
_UNSAFE = rf"\W(?=[{_FIRST}])((?i:{'|'.join(UNSAFE_WORDS)}))(?!\w)"
_SET = r"\W(?i:SET)(?!\w)(?!\s+(?i:search_path)(?!\w))"
_LITERAL = "'[^']*'"
# Spark's own literals: either quote, with backslash escapes.
_SPARK_LITERAL = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""
# Names, literals and comments in one pattern, because each can hold the start of another.
_NOT_CODE = rf"(?s)(`[^`]*`)|{_SPARK_LITERAL}|/\*.*?\*/|--[^\n]*"
_JVM_CALL = ascii_word(["reflect", "try_reflect", "java_method"]) + r"\s*\("
_FILE_SCAN = r"(?i)(?<![A-Za-z0-9_])(parquet|orc|csv|json|text|xml|avro|binaryfile|jdbc)\s*\.\s*`"


def sanitise(sql: Column | str) -> Column:
    """Without trailing blanks and semicolons."""
    return F.rtrim(sql, F.lit(WHITE_SPACE + ";"))


def screen_keyword(sanitised: Column) -> Column:
    """The first unsafe word outside literals, in upper case; empty if none."""
    text = F.when(sanitised.contains("'"), F.regexp_replace(sanitised, _LITERAL, "")).otherwise(sanitised)
    bare = F.concat(F.lit(" "), text)
    word = F.upper(F.regexp_extract(bare, _UNSAFE, 1))
    return F.when(word != "", word).when(bare.rlike(_SET), "SET").otherwise("")


def screen(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``sanitized, keyword, allowed, error_code, message`` to a table of statements.

    Column expressions only, so the same call works on a stream.
    """
    return (statements
            .withColumn("sanitized", sanitise(sql))
            .withColumn("keyword", F.when(is_blank(sql), "").otherwise(screen_keyword(F.col("sanitized"))))
            .withColumn("allowed", ~is_blank(sql) & (F.col("keyword") == ""))
            .withColumn("error_code", F.when(~F.col("allowed"), ERROR_CODE))
            .withColumn("message", F.when(is_blank(sql), EMPTY_MESSAGE).when(
                F.col("keyword") != "", F.format_string(UNSAFE_MESSAGE.replace("{}", "%s"), "keyword"))))


def spark_reason(sql: Column | str) -> Column:
    """Why Spark should not run a statement that the word list lets pass; null if it may.

    Checks the first word, calls into the JVM, and direct reads of files by path,
    on the text without Spark's literals and comments; and the word list once more
    there, because Spark ends a literal at other places than the screen does.
    """
    bare = F.concat(F.lit(" "), F.regexp_replace(sanitise(sql), _NOT_CODE, "$1 "))
    first = F.upper(F.regexp_extract(bare, r"\A[\s(]*([A-Za-z]+)", 1))
    word = F.upper(F.regexp_extract(bare, _UNSAFE, 1))
    inner = F.regexp_extract(bare, r"(?i)\A\s*EXPLAIN(?:\s+(?:EXTENDED|CODEGEN|COST|FORMATTED))?\s+([A-Za-z]+)", 1)
    return (F.when(word != "", word)
            .when(~first.isin(READ_WORDS), first)
            .when((inner != "") & ~F.upper(inner).isin(READ_WORDS), F.upper(inner))
            .when(bare.rlike(r";\s*\S"), ";")
            .when(bare.rlike(_JVM_CALL), "JVM CALL")
            .when(bare.rlike(_FILE_SCAN), "FILE SCAN"))


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Kinds:
    """Tests of plan and expression nodes by Spark's own classes."""

    def __init__(self, spark: SparkSession):
        names = ("plans.logical.Command", "plans.logical.ParsedStatement", "plans.logical.ScriptTransformation", "expressions.PlanExpression", "analysis.UnresolvedFunction",
                 "analysis.UnresolvedTableValuedFunction", "analysis.ExpressionWithUnresolvedIdentifier", "expressions.CallMethodViaReflection", "expressions.UserDefinedExpression")
        self.of = {name.rsplit(".", 1)[-1]: spark._jvm.java.lang.Class.forName(f"{CATALYST}.{name}") for name in names}

    def __call__(self, node, *names: str) -> bool:
        return any(self.of[name].isInstance(node) for name in names)


def _nodes(root, kinds: _Kinds) -> Iterator:
    """Every node of a plan and every expression in it, in sub-queries and under EXPLAIN too."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        yield node
        if node.nodeName().startswith("Explain"):
            waiting.append(node.logicalPlan())
        waiting += _items(node.children()) + [p for p in _items(node.innerChildren()) if hasattr(p, "expressions")]
        inside = _items(node.expressions())
        while inside:
            e = inside.pop()
            yield e
            if kinds(e, "PlanExpression"):
                waiting.append(e.plan())
            inside += _items(e.children())


def safe_functions(spark: SparkSession) -> set[str]:
    """The built-in functions, without those that call the JVM and those that tell where files are."""
    return {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - UNSAFE_FUNCTIONS


def plan_reason(spark: SparkSession, sql: str, functions: Iterable[str] = ()) -> str | None:
    """Why Spark should not run a statement, by its parsed plan; null if it may.

    Refused are commands, writes and scripts, wherever they stand in the statement, in
    its sub-queries or under an EXPLAIN; and functions that are neither built-in and
    safe nor among ``functions``, however their names are written. A statement that
    can't be parsed has no plan to refuse, and fails when it is run.
    """
    kinds, allowed = _Kinds(spark), None
    for node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), kinds):
        if kinds(node, "ScriptTransformation"):
            return "SCRIPT"
        if kinds(node, "Command", "ParsedStatement") and not node.nodeName().startswith((*READ_COMMANDS, "Explain")):
            return node.nodeName().upper()
        if kinds(node, "ExpressionWithUnresolvedIdentifier"):
            return "IDENTIFIER"
        if kinds(node, "UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = [p.lower() for p in _items(node.nameParts() if kinds(node, "UnresolvedFunction") else node.name())]
            allowed = allowed or safe_functions(spark) | {f.lower() for f in functions}
            if parts[-1] not in allowed or len(parts) > 1 and parts[:-1] not in BUILT_IN_SCHEMAS and ".".join(parts) not in allowed:
                return f"FUNCTION {parts[-1].upper()}"
    return None


def analysed_reason(df: DataFrame, functions: Iterable[str] = ()) -> str | None:
    """Why a statement should not be run, by its analysed plan, in which views are spelled out; null if it may."""
    kinds, allowed = _Kinds(df.sparkSession), {f.lower() for f in functions}
    for node in _nodes(df._jdf.queryExecution().analyzed(), kinds):
        if kinds(node, "CallMethodViaReflection"):
            return "JVM CALL"
        if kinds(node, "UserDefinedExpression") and node.name().lower() not in allowed:
            return f"FUNCTION {node.name().upper()}"
    return None


class Guarded(NamedTuple):
    """A lazy result, or none and the text of the refusal."""

    result: DataFrame | None
    error: str | None


def guarded_sql(spark: SparkSession, sql: str | None, functions: Iterable[str] = ()) -> Guarded:
    """Screen one statement and, if it is a read, hand it to Spark unexecuted.

    The word list and the text come first, then the parsed plan, then the analysed one.
    Names are resolved with files as tables switched off, so no path can be read.
    ``functions`` names functions of the user's own that statements may call.
    """
    one = spark.createDataFrame([(sql,)], "sql string")
    row = screen(one).withColumn("reason", spark_reason("sql")).first()
    if not row["allowed"]:
        return Guarded(None, f"[sql error] {row['message']}")
    by_path = spark.conf.get("spark.sql.runSQLOnFiles")
    try:
        reason = row["reason"] or plan_reason(spark, row["sanitized"], functions)
        if not reason:
            spark.conf.set("spark.sql.runSQLOnFiles", "false")
            result = spark.sql(row["sanitized"])
            reason = analysed_reason(result, functions)
        return Guarded(None, f"[sql error] {UNSAFE_MESSAGE.format(reason)}") if reason else Guarded(result, None)
    except Exception as failure:  # parse and analysis errors become the answer text
        return Guarded(None, f"[sql error] {str(failure).splitlines()[0]}")
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", by_path)


# Words counted as keywords in a query log.
PROFILE_WORDS = ["SELECT", "FROM", "WHERE", "JOIN", "LEFT", "RIGHT", "INNER", "GROUP BY", "ORDER BY", "HAVING", "LIMIT",
                 "AS", "ON", "AND", "OR", "NOT", "IN", "BETWEEN", "LIKE", "COUNT", "SUM", "AVG", "MAX", "MIN",
                 "DISTINCT", "WITH", "CASE", "WHEN", "THEN", "ELSE", "END", "NULL", "IS", "DESC", "ASC", "UNION"]
_TOKEN = (r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|""" + ascii_word(sorted(PROFILE_WORDS, key=lambda w: (-len(w), w)))
          + r"|(?<!\w)[0-9]+(?:\.[0-9]+)?(?!\w)")


def sql_tokens(sql: Column | str) -> Column:
    """Literals, keywords and numbers of a statement, in order; keywords in upper case."""
    found = F.regexp_extract_all(sql, F.lit(_TOKEN), 0)
    return F.transform(found, lambda t: F.when(t.rlike("\\A['\"]"), t).otherwise(
        F.upper(F.regexp_replace(t, r"\s+", " "))))


def statement_profile(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``n_literals, n_keywords, n_numbers`` per statement."""
    toks = F.col("__tokens")

    def count(pattern: str) -> Column:
        return F.size(F.filter(toks, lambda t: t.rlike(pattern)))

    return (statements.withColumn("__tokens", sql_tokens(sql))
            .withColumn("n_literals", count("\\A['\"]"))
            .withColumn("n_keywords", count(r"\A[A-Z]"))
            .withColumn("n_numbers", count(r"\A[0-9]"))
            .drop("__tokens"))


def keyword_frequency(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """How often each keyword occurs over the whole log."""
    # The outer form keeps Spark from testing the array's size first, which would scan each text twice.
    words = statements.select(F.explode_outer(F.filter(sql_tokens(sql), lambda t: t.rlike(r"\A[A-Z]"))).alias("keyword"))
    return words.where("keyword IS NOT NULL").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
