"""Constraint audit, derived totals, and column profiles."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardedlake.functions.text import strip


class RowRule(NamedTuple):
    """A condition each row has to meet; a null result counts as met, as in SQL checks."""

    name: str
    holds: Column


def not_null(col: str) -> RowRule:
    return RowRule(f"not_null({col})", F.col(col).isNotNull())


def one_of(col: str, values: list) -> RowRule:
    return RowRule(f"check({col})", F.col(col).isin(values))


def max_length(col: str, n: int) -> RowRule:
    return RowRule(f"length({col})", F.length(col) <= n)


def audit_rows(table: str, df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """Violations of all row rules of a table in one pass."""
    counted = df.agg(*[F.count_if(~F.coalesce(r.holds, F.lit(True))).alias(str(i)) for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(str(i)).alias("violations")) for i, r in enumerate(rules)])
    return counted.select(F.lit(table).alias("table_name"), F.inline(pairs))


def audit_unique(table: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key; nulls are no duplicates."""
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    per_key = df.where(full).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(f"unique({', '.join(keys)})").alias("rule"), "violations")


def audit_foreign_key(table: str, df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent.

    Rows are counted per key before the join, so a key that a third of the rows
    carry crosses the network as one row.
    """
    per_key = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    orphans = per_key.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(f"foreign_key({key})").alias("rule"), "violations")


class ForeignKey(NamedTuple):
    """Each value of ``col`` has to be one of ``parent_col`` in the rows of ``parent`` that meet ``where``."""

    col: str
    parent: str
    parent_col: str
    where: Column | None = None


class TableRules(NamedTuple):
    """What the rows of a table have to meet."""

    rows: tuple[RowRule, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()


class _Mark(NamedTuple):
    """What a scan gives out for a rule: a key under a condition, from the parent's side or the child's."""

    rule: int
    when: Column
    key: dict[str, Column]
    parent: bool = False


_LONGS = ("tinyint", "smallint", "int", "bigint")
_KEY_COLUMNS = {"num": "bigint", "num2": "bigint", "text": "string"}


def _key(cols: list[Column], kinds: list[str]) -> dict[str, Column]:
    """A key as one or two longs, or as a text; parts of a text carry their length, so no two keys have one text."""
    if len(cols) <= 2 and all(k in _LONGS for k in kinds):
        return {name: c.cast("bigint") for name, c in zip(_KEY_COLUMNS, cols)}
    parts = [F.hex(c) if k == "binary" else c.cast("string") for c, k in zip(cols, kinds)]
    return {"text": parts[0] if len(parts) == 1 else F.concat(*[e for p in parts for e in (F.length(p).cast("string"), F.lit(":"), p)])}


def audit_tables(tables: dict[str, DataFrame], rules: dict[str, TableRules]) -> DataFrame:
    """``(table_name, rule, violations)`` of all rules, with one scan a table and one shuffle.

    A scan gives out marked rows, ``(rule, key)``: a row that fails a row rule, a key
    that has to be unique, a foreign key, and, where a table is a parent, its keys under
    the rule of the child. They are counted per rule and key in each task before they
    move, so a key of a third of the rows is one row a task, and the sides of a foreign
    key meet in the count, without a join. A Bloom filter of parents would spare nothing:
    it clears no foreign key for certain, as a false hit hides an orphan.

    One or two whole numbers travel as longs and other keys as text, foreign keys after a cast
    to the parent's type; one that can't be cast is an orphan. Nulls break no key rule,
    and no row rule whose condition they make null. A rule over empty tables has 0
    violations; one that names an unknown table or column raises.
    """
    listed: list[tuple[str, str, str]] = []
    marks: dict[str, list[_Mark]] = {t: [] for t in tables}

    def add(table: str, name: str, kind: str) -> int:
        listed.append((table, name, kind))
        return len(listed) - 1

    def type_of(table: str, col: str) -> str:
        return tables[table].select(col).schema[0].dataType.simpleString()

    for table, of in rules.items():
        for r in of.rows:
            marks[table].append(_Mark(add(table, r.name, "row"), ~F.coalesce(r.holds, F.lit(True)), {}))
        for cols in of.unique:
            full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
            marks[table].append(_Mark(add(table, f"unique({', '.join(cols)})", "unique"), full, _key([F.col(c) for c in cols], [type_of(table, c) for c in cols])))
        for f in of.foreign:
            n, kind, there = add(table, f"foreign_key({f.col})", "foreign"), type_of(f.parent, f.parent_col), F.col(f.parent_col).isNotNull()
            marks[table].append(_Mark(n, F.col(f.col).isNotNull(), _key([F.col(f.col).try_cast(kind)], [kind])))
            marks[f.parent].append(_Mark(n, there if f.where is None else there & f.where, _key([F.col(f.parent_col)], [kind]), parent=True))
    if not listed:
        raise ValueError("no rules to audit")

    # Keys without a text are of fixed width, which is what hashing is fast on.
    used = [k for k in _KEY_COLUMNS if any(k in m.key for of in marks.values() for m in of)]

    def given_out(table: str) -> DataFrame:
        rows = [F.when(m.when, F.struct(F.lit(m.rule).alias("rule"), *[m.key.get(k, F.lit(None).cast(_KEY_COLUMNS[k])).alias(k) for k in used], F.lit(m.parent).alias("parent")))
                for m in marks[table]]
        return tables[table].select(F.inline(F.array(*rows))).where("rule IS NOT NULL")

    per_key = (reduce(DataFrame.unionByName, [given_out(t) for t in tables if marks[t]]).groupBy("rule", *used)
               .agg(F.count_if(~F.col("parent")).alias("n"), F.bool_or("parent").alias("has_parent")))
    kind = F.element_at(F.array(*[F.lit(k) for _, _, k in listed]), F.col("rule") + 1)
    broken = F.when(kind == "unique", F.col("n") - 1).when((kind == "foreign") & F.col("has_parent"), 0).otherwise(F.col("n"))
    # Each rule has a row, whether or not a table gave out anything for it.
    every = next(iter(tables.values())).sparkSession.range(len(listed)).select(F.col("id").cast("int").alias("rule"), F.lit(0).cast("bigint").alias("violations"))
    total = per_key.select("rule", broken.alias("violations")).unionByName(every).groupBy("rule").agg(F.sum("violations").alias("violations"))
    name = F.element_at(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(r).alias("rule")) for t, r, _ in listed]), F.col("rule") + 1)
    return total.select(name.alias("of"), "violations").select("of.table_name", "of.rule", "violations")


def audit(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_total(df: DataFrame, parts: list[str], out: str) -> DataFrame:
    """A derived column: the sum of others."""
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(p) for p in parts]))


NUMERIC_TEXT = r"\A[$€£]?[0-9,]+\.?[0-9]*%?\z"


def text_profile(table: str, df: DataFrame, limit: int = 40) -> DataFrame:
    """Per string column: nulls, numeric-looking values, lengths, values over the limit.

    All columns are profiled in one pass of partial aggregates.
    """
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    trimmed = {c: strip(c) for c in cols}
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), *[e for i, c in enumerate(cols) for e in (
        F.count_if(F.col(c).isNull()).alias(f"{i}_null"),
        F.count_if(trimmed[c].rlike(NUMERIC_TEXT)).alias(f"{i}_num"),
        F.max(F.length(c)).alias(f"{i}_max"),
        F.sum(F.length(c)).alias(f"{i}_sum"),
        F.count_if(F.length(c) > limit).alias(f"{i}_over"))])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{i}_null").alias("n_null"), F.col(f"{i}_num").alias("n_numeric"),
        F.coalesce(f"{i}_max", F.lit(0)).alias("max_length"), F.coalesce(f"{i}_sum", F.lit(0)).alias("total_length"),
        F.col(f"{i}_over").alias("n_over_limit")) for i, c in enumerate(cols)])
    return stats.select(F.lit(table).alias("table_name"), "n_rows", F.inline(rows))
