"""The star-schema tables seen as finance and rental tables, and the same views in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardedlake.sources.tables import Tables


class StarFinance:
    """``analytics.Finance`` over the star tables; each frame is built when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.t = Tables(spark, folder)

    @cached_property
    def units(self) -> DataFrame:
        t = self.t
        return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("region"),
            F.concat(F.lit("CC-"), (F.col("n_nationkey") + 1000).cast("string")).alias("cost_center"),
            (F.col("n_nationkey") * 7 + 20).alias("head_count"))

    # What the tables hold for each account type and entry status; all other values mean the last one.
    TYPES = {"STANDARD": "ASSET", "MEDIUM": "LIABILITY", "LARGE": "EQUITY", "PROMO": "REVENUE", None: "EXPENSE"}
    STATES = {"P": "PENDING", "F": "POSTED", None: "REVERSED"}

    def _meaning(self, column: str, of: dict) -> Column:
        out = F.lit(of[None])
        for raw, shown in of.items():
            if raw is not None:
                out = F.when(F.col(column) == raw, shown).otherwise(out)
        return out

    def _holds(self, column: str, of: dict, wanted: str) -> Column:
        """The rows of a meaning, as a filter on what the table holds: one that reaches the scan."""
        if of[None] == wanted:
            return F.col(column).isNull() | ~F.col(column).isin([r for r in of if r is not None])
        return F.col(column) == next(r for r, shown in of.items() if shown == wanted)

    def _accounts(self, part: DataFrame) -> DataFrame:
        return part.select(
            F.col("p_partkey").alias("account_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("account_name"),
            self._meaning("p_type", self.TYPES).alias("account_type"))

    def _entries(self, orders: DataFrame) -> DataFrame:
        return orders.select(
            F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").cast("date").alias("entry_date"),
            F.col("o_orderpriority").alias("description"),
            F.concat(F.lit("clerk-"), F.col("o_custkey").cast("string")).alias("created_by"), self._meaning("o_orderstatus", self.STATES).alias("status"))

    @cached_property
    def accounts(self) -> DataFrame:
        return self._accounts(self.t.part)

    @cached_property
    def entries(self) -> DataFrame:
        return self._entries(self.t.orders)

    def accounts_of(self, account_type: str) -> DataFrame:
        return self._accounts(self.t.part.where(self._holds("p_type", self.TYPES, account_type)))

    def entries_of(self, status: str) -> DataFrame:
        return self._entries(self.t.orders.where(self._holds("o_orderstatus", self.STATES, status)))

    @cached_property
    def lines(self) -> DataFrame:
        price = F.col("l_extendedprice")
        return self.t.lineitem.select(
            F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("account_id"),
            (F.col("l_suppkey") % 25).cast("int").alias("business_unit_id"),
            F.when(F.col("l_linestatus") == "O", price).otherwise(0.0).alias("debit_amount"),
            F.when(F.col("l_linestatus") == "F", price).otherwise(0.0).alias("credit_amount"))

    @cached_property
    def budgets(self) -> DataFrame:
        quarters = [(F.col("p_retailprice") * n).alias(f"q{n}_amount") for n in (1, 2, 3, 4)]
        return self.t.part.select(F.lit(1998).alias("fiscal_year"), (F.col("p_partkey") % 25).cast("int").alias("business_unit_id"),
                                  F.col("p_partkey").alias("account_id"), *quarters)

    @cached_property
    def invoices(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        status = (F.when(F.col("o_orderpriority") == "1-URGENT", "OVERDUE").when(F.col("o_orderstatus") == "F", "PAID")
                  .when(F.col("o_orderstatus") == "P", "DISPUTED").otherwise("OUTSTANDING"))
        return self.t.orders.select(
            F.col("o_orderkey").alias("invoice_id"), F.concat(F.lit("Vendor "), F.col("o_custkey").cast("string")).alias("vendor_name"),
            day.alias("invoice_date"), F.date_add(day, 30).alias("due_date"), F.col("o_totalprice").alias("amount"),
            status.alias("status"), (F.col("o_custkey") % 25).cast("int").alias("business_unit_id"))

    @cached_property
    def cash_flow(self) -> DataFrame:
        flow = F.when(F.col("event_type").isin("view", "click"), "OPERATING").when(F.col("event_type") == "signup", "INVESTING").otherwise("FINANCING")
        return self.t.events.select(F.col("event_id").alias("flow_id"), F.col("ts").cast("date").alias("flow_date"),
                                    flow.alias("flow_type"), F.col("value").alias("amount"))


FINANCE_SQL = """
WITH units AS (
  SELECT n_nationkey AS id, n_name AS name, r_name AS region, n_nationkey * 7 + 20 AS head_count
  FROM nation JOIN region ON n_regionkey = r_regionkey),
accounts AS (
  SELECT p_partkey AS account_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS account_name,
    CASE p_type WHEN 'STANDARD' THEN 'ASSET' WHEN 'MEDIUM' THEN 'LIABILITY' WHEN 'LARGE' THEN 'EQUITY'
      WHEN 'PROMO' THEN 'REVENUE' ELSE 'EXPENSE' END AS account_type
  FROM part),
entries AS (
  SELECT o_orderkey AS entry_id, CAST(o_orderdate AS DATE) AS entry_date, o_orderpriority AS description,
    'clerk-' || CAST(o_custkey AS VARCHAR) AS created_by,
    CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'POSTED' ELSE 'REVERSED' END AS status
  FROM orders),
lines AS (
  SELECT l_orderkey AS entry_id, l_partkey AS account_id, l_suppkey % 25 AS business_unit_id,
    CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END AS debit_amount,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END AS credit_amount
  FROM lineitem),
budgets AS (
  SELECT 1998 AS fiscal_year, p_partkey % 25 AS business_unit_id, p_partkey AS account_id, p_retailprice AS q1_amount,
    p_retailprice * 2 AS q2_amount, p_retailprice * 3 AS q3_amount, p_retailprice * 4 AS q4_amount
  FROM part),
invoices AS (
  SELECT o_orderkey AS invoice_id, 'Vendor ' || CAST(o_custkey AS VARCHAR) AS vendor_name,
    CAST(o_orderdate AS DATE) + 30 AS due_date, o_totalprice AS amount, o_custkey % 25 AS business_unit_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'OVERDUE' WHEN o_orderstatus = 'F' THEN 'PAID'
      WHEN o_orderstatus = 'P' THEN 'DISPUTED' ELSE 'OUTSTANDING' END AS status
  FROM orders),
cash_flow AS (
  SELECT event_id AS flow_id, CAST(ts AS DATE) AS flow_date, value AS amount,
    CASE WHEN event_type IN ('view', 'click') THEN 'OPERATING' WHEN event_type = 'signup' THEN 'INVESTING' ELSE 'FINANCING' END AS flow_type
  FROM events)
"""


class StarRental:
    """``analytics.Rental`` over the star tables; each frame is built when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.t = Tables(spark, folder)

    @cached_property
    def films(self) -> DataFrame:
        return self.t.part.select(
            F.col("p_partkey").alias("film_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"),
            (F.col("p_size") * 4).alias("length"), (F.col("p_size") % 7 + 1).alias("rental_duration"), F.col("p_type").alias("category"))

    @cached_property
    def actors(self) -> DataFrame:
        return self.t.supplier.select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("first_name"),
                                      F.col("s_nationkey").cast("string").alias("last_name"))

    @cached_property
    def film_actors(self) -> DataFrame:
        return self.t.lineitem.select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("actor_id")).distinct()

    @cached_property
    def inventory(self) -> DataFrame:
        return self.t.customer.select(F.col("c_custkey").alias("inventory_id"), F.col("c_custkey").alias("film_id"))

    @cached_property
    def rentals(self) -> DataFrame:
        return self.t.orders.select(F.col("o_orderkey").alias("rental_id"), F.col("o_custkey").alias("inventory_id"), F.col("o_custkey").alias("customer_id"),
                                    F.col("o_orderdate").alias("rental_date"), F.date_add(F.col("o_orderdate").cast("date"), 7).alias("return_date"))

    @cached_property
    def payments(self) -> DataFrame:
        return self.t.lineitem.select(F.col("l_orderkey").alias("rental_id"), F.col("l_suppkey").alias("staff_id"), F.col("l_extendedprice").alias("amount"))

    @cached_property
    def customers(self) -> DataFrame:
        return self.t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("last_name"))

    @cached_property
    def staff(self) -> DataFrame:
        return self.t.supplier.select(
            F.col("s_suppkey").alias("staff_id"), F.col("s_name").alias("first_name"), F.col("s_nationkey").cast("string").alias("last_name"),
            F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"), F.col("s_nationkey").alias("store_id"))

    @cached_property
    def stores(self) -> DataFrame:
        return self.t.nation.select(F.col("n_nationkey").alias("store_id"), F.col("n_nationkey").alias("city_id"))

    @cached_property
    def cities(self) -> DataFrame:
        return self.t.nation.select(F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("country_id"))

    @cached_property
    def countries(self) -> DataFrame:
        return self.t.region.select(F.col("r_regionkey").alias("country_id"), F.col("r_name").alias("country"))
