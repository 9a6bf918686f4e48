"""Q1 to Q26 on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardedlake.plans import analytics as a
from guardedlake.plans.registry import named
from guardedlake.plans.star import FINANCE_SQL, StarFinance, StarRental
from guardedlake.sources.tables import Tables

_POSTED = "JOIN entries e ON e.entry_id = l.entry_id AND e.status = 'POSTED'"


@named("q01_revenue_by_unit", FINANCE_SQL + f"""
SELECT u.name AS business_unit, CAST(sum(CAST(l.credit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total_revenue
FROM lines l {_POSTED} JOIN accounts a ON a.account_id = l.account_id JOIN units u ON u.id = l.business_unit_id
WHERE a.account_type = 'REVENUE' AND e.entry_date >= DATE '1998-01-01' GROUP BY u.name ORDER BY 2 DESC, 1""")
def q01(spark, folder):
    return a.revenue_by_unit(StarFinance(spark, folder), "1998-01-01")


@named("q02_over_budget", FINANCE_SQL + f"""
SELECT u.name AS business_unit, a.account_name, CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS actual, b.q3_amount AS budget,
  round(CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) - b.q3_amount, 2) AS variance
FROM lines l {_POSTED} JOIN accounts a ON a.account_id = l.account_id JOIN units u ON u.id = l.business_unit_id
JOIN budgets b ON b.business_unit_id = u.id AND b.account_id = l.account_id AND b.fiscal_year = 1998
WHERE a.account_type = 'EXPENSE' AND e.entry_date >= DATE '1998-07-01' AND e.entry_date < DATE '1998-10-01'
GROUP BY u.name, a.account_id, a.account_name, b.q3_amount HAVING CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) > b.q3_amount""")
def q02(spark, folder):
    return a.over_budget(StarFinance(spark, folder), 1998, 3)


@named("q03_overdue_invoices", FINANCE_SQL + """
SELECT i.invoice_id, i.vendor_name, i.amount, strftime(i.due_date, '%Y-%m-%d') AS due_date,
  date_diff('day', i.due_date, DATE '2002-01-01') AS days_overdue, u.name AS business_unit
FROM invoices i JOIN units u ON u.id = i.business_unit_id WHERE i.status = 'OVERDUE' AND i.amount > 10000""")
def q03(spark, folder):
    return a.overdue_invoices(StarFinance(spark, folder), 10000, "2002-01-01")


@named("q04_monthly_cash_flow", FINANCE_SQL + """
SELECT strftime(date_trunc('month', flow_date), '%Y-%m-%d') AS month, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS net_cash_flow
FROM cash_flow WHERE flow_type = 'OPERATING' GROUP BY 1 ORDER BY 1""")
def q04(spark, folder):
    return a.monthly_cash_flow(StarFinance(spark, folder), "OPERATING")


@named("q05_top_expense_accounts", FINANCE_SQL + f"""
SELECT a.account_id, a.account_name, CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total_spend
FROM lines l {_POSTED} JOIN accounts a ON a.account_id = l.account_id WHERE a.account_type = 'EXPENSE'
GROUP BY a.account_id, a.account_name ORDER BY 3 DESC, 1 LIMIT 10""")
def q05(spark, folder):
    return a.top_expense_accounts(StarFinance(spark, folder))


@named("q06_quarterly_growth", FINANCE_SQL + f""",
earned AS (SELECT quarter(e.entry_date) AS q, CAST(sum(CAST(l.credit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM accounts a
  JOIN lines l ON l.account_id = a.account_id {_POSTED} WHERE a.account_type = 'REVENUE' AND year(e.entry_date) = 1998 GROUP BY ALL)
SELECT now.q AS quarter, now.total AS revenue, before.total AS prev_quarter, round((now.total - before.total) / before.total * 100, 1) AS growth_pct
FROM earned now LEFT JOIN earned before ON before.q = now.q - 1""")
def q06(spark, folder):
    return a.quarterly_growth(StarFinance(spark, folder), 1998)


@named("q07_expenses_by_unit", FINANCE_SQL + f"""
SELECT u.name AS business_unit, u.region, CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total_expenses, u.head_count,
  ((CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) * 200 AS HUGEINT) + u.head_count) // (2 * u.head_count)) / 100 AS cost_per_head
FROM lines l {_POSTED} JOIN accounts a ON a.account_id = l.account_id JOIN units u ON u.id = l.business_unit_id
WHERE a.account_type = 'EXPENSE' AND e.entry_date >= DATE '1998-01-01' GROUP BY u.name, u.region, u.head_count""")
def q07(spark, folder):
    return a.expenses_by_unit(StarFinance(spark, folder), "1998-01-01")


@named("q08_pending_entries", FINANCE_SQL + """
SELECT e.entry_id, strftime(e.entry_date, '%Y-%m-%d') AS entry_date, e.description, e.created_by, CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total_amount
FROM entries e JOIN lines l ON l.entry_id = e.entry_id WHERE e.status = 'PENDING'
GROUP BY e.entry_id, e.entry_date, e.description, e.created_by""")
def q08(spark, folder):
    return a.pending_entries(StarFinance(spark, folder))


@named("q09_vendor_spend", FINANCE_SQL + """,
cents AS (SELECT *, CAST(amount AS DECIMAL(18, 2)) AS paid FROM invoices)
SELECT vendor_name, count(paid) AS invoice_count, CAST(sum(paid) AS DOUBLE) AS total_spend, CAST(coalesce(sum(paid) FILTER (status = 'OVERDUE'), 0) AS DOUBLE) AS overdue_amount
FROM cents GROUP BY vendor_name ORDER BY total_spend DESC, vendor_name LIMIT 10""")
def q09(spark, folder):
    return a.vendor_spend(StarFinance(spark, folder))


@named("q10_cost_per_employee", FINANCE_SQL + f"""
SELECT u.name AS business_unit, u.head_count, CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total_salary_cost,
  ((CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) * 200 AS HUGEINT) + u.head_count) // (2 * u.head_count)) / 100 AS cost_per_employee
FROM lines l {_POSTED} JOIN units u ON u.id = l.business_unit_id WHERE l.account_id < 100 GROUP BY u.name, u.head_count""")
def q10(spark, folder):
    return a.cost_per_employee(StarFinance(spark, folder), F.col("account_id") < 100)


@named("q11_budget_variance", FINANCE_SQL + f""",
spent AS (SELECT a.account_id, a.account_name, CAST(sum(CAST(l.debit_amount AS DECIMAL(18, 2))) AS DOUBLE) AS actual
  FROM lines l {_POSTED} JOIN accounts a ON a.account_id = l.account_id JOIN units u ON u.id = l.business_unit_id
  WHERE a.account_type = 'EXPENSE' AND e.entry_date >= DATE '1998-01-01' AND e.entry_date < DATE '1999-01-01' AND u.name = 'NATION_7'
  GROUP BY a.account_id, a.account_name),
planned AS (SELECT b.account_id, round(sum(q1_amount + q2_amount + q3_amount + q4_amount), 2) AS budget
  FROM budgets b JOIN units u ON u.id = b.business_unit_id WHERE b.fiscal_year = 1998 AND u.name = 'NATION_7' GROUP BY b.account_id)
SELECT s.account_id, s.account_name, s.actual, p.budget, round(s.actual - p.budget, 2) AS variance,
  round(round(s.actual - p.budget, 2) / nullif(p.budget, 0) * 100, 1) AS variance_pct
FROM spent s LEFT JOIN planned p ON p.account_id = s.account_id""")
def q11(spark, folder):
    return a.budget_variance(StarFinance(spark, folder), "NATION_7", 1998)


@named("q12_film_count", "SELECT count(*) AS film_count FROM part")
def q12(spark, folder):
    return a.count_all(StarRental(spark, folder).films, "film_count")


@named("q13_top_films", """
SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title, round(sum(l_extendedprice), 2) AS total_revenue
FROM part JOIN customer ON c_custkey = p_partkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def q13(spark, folder):
    return a.top_films(StarRental(spark, folder))


@named("q14_prolific_actors", """
SELECT s_suppkey AS actor_id, s_name || ' ' || CAST(s_nationkey AS VARCHAR) AS actor_name, count(DISTINCT l_partkey) AS film_count
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, s_nationkey ORDER BY 3 DESC, 1 LIMIT 5""")
def q14(spark, folder):
    return a.prolific_actors(StarRental(spark, folder))


@named("q15_films_per_category", "SELECT p_type AS category, count(p_partkey) AS film_count FROM part GROUP BY p_type ORDER BY 2 DESC, 1")
def q15(spark, folder):
    return a.films_per_category(StarRental(spark, folder))


@named("q16_frequent_customers", """
SELECT c_custkey AS customer_id, c_name || ' ' || c_mktsegment AS customer_name, count(o_orderkey) AS rental_count
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment HAVING count(o_orderkey) > 12""")
def q16(spark, folder):
    return a.frequent_customers(StarRental(spark, folder), 12)


@named("q17_duration_per_category", """
SELECT p_type AS category, ((sum(p_size % 7 + 1) * 200 + count(*)) // (2 * count(*))) / 100 AS avg_duration_days FROM part GROUP BY p_type""")
def q17(spark, folder):
    return a.duration_per_category(StarRental(spark, folder))


@named("q18_long_films", """
SELECT p_partkey AS film_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title, p_size * 4 AS length FROM part WHERE p_size * 4 > 180""")
def q18(spark, folder):
    return a.long_films(StarRental(spark, folder))


@named("q19_staff_list", """
SELECT s_suppkey AS staff_id, s_name || ' ' || CAST(s_nationkey AS VARCHAR) AS staff_name, lower(s_name) || '@example.com' AS email,
  s_nationkey AS store_id FROM supplier""")
def q19(spark, folder):
    return a.staff_list(StarRental(spark, folder))


@named("q20_revenue_by_store", """
SELECT n_nationkey AS store_id, n_name || ', ' || r_name AS location, round(sum(l_extendedprice), 2) AS total_revenue
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY n_nationkey, n_name, r_name""")
def q20(spark, folder):
    return a.revenue_by_store(StarRental(spark, folder))


@named("q21_rental_history", """
SELECT o_orderkey AS rental_id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS rental_date, strftime(CAST(o_orderdate AS DATE) + 7, '%Y-%m-%d') AS return_date
FROM customer JOIN orders ON o_custkey = c_custkey JOIN part ON p_partkey = c_custkey
WHERE c_name = 'Customer#000000007' AND c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 7)
ORDER BY o_orderdate DESC, 1 DESC, 2 LIMIT 10""")
def q21(spark, folder):
    r = StarRental(spark, folder)
    segment = r.customers.where("first_name = 'Customer#000000007'").select("last_name").first()
    out = a.rental_history(r, "Customer#000000007", segment["last_name"] if segment else "")
    return out.withColumn("return_date", F.substring("return_date", 1, 10))


@named("q22_average_balance", "SELECT c_mktsegment AS segment, round(avg(c_acctbal), 4) AS avg_balance FROM customer GROUP BY 1")
def q22(spark, folder):
    return a.average_by(Tables(spark, folder).customer.withColumnRenamed("c_mktsegment", "segment"), "segment", "c_acctbal", "avg_balance")


@named("q23_large_priorities", """
WITH counts AS (SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1) SELECT priority, n FROM counts WHERE n >= 100""")
def q23(spark, folder):
    return a.counted_groups(Tables(spark, folder).orders.withColumnRenamed("o_orderpriority", "priority"), "priority", 100)


@named("q24_customers_with_large_orders", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def q24(spark, folder):
    t = Tables(spark, folder)
    return a.having_related(t.customer.select("c_custkey", "c_name"), t.orders.where("o_totalprice > 400000"), "c_custkey", "o_custkey")


@named("q25_previous_month_orders", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-04-01' AND o_orderdate < TIMESTAMP '1998-05-01'""")
def q25(spark, folder):
    df = a.previous_month(Tables(spark, folder).orders, "o_orderdate", "1998-05-17")
    return df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_totalprice")


@named("q26_top_customers", """
SELECT c_custkey AS customer_id, c_name AS name, round(sum(o_totalprice), 2) AS total_spend,
  '$' || format('{:,.2f}', round(sum(o_totalprice), 2)) AS total_spend_text
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""")
def q26(spark, folder):
    t = Tables(spark, folder)
    return a.top_customers(t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount")),
                           t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")))
