"""Business questions over finance and rental tables, as DataFrame functions.

Amounts have two decimals and are summed as decimals; totals come out as doubles. Every
ordered result ends its order with a key, so it is the same on every run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardedlake.functions.text import currency


class Finance(NamedTuple):
    """Units, accounts, entries with lines, budgets, invoices and cash movements."""

    units: DataFrame      # id, name, region, cost_center, head_count
    accounts: DataFrame   # account_id, account_name, account_type
    entries: DataFrame    # entry_id, entry_date, description, created_by, status
    lines: DataFrame      # entry_id, account_id, business_unit_id, debit_amount, credit_amount
    budgets: DataFrame    # fiscal_year, business_unit_id, account_id, q1_amount .. q4_amount
    invoices: DataFrame   # invoice_id, vendor_name, invoice_date, due_date, amount, status, business_unit_id
    cash_flow: DataFrame  # flow_id, flow_date, flow_type, amount


    def accounts_of(self, account_type: str) -> DataFrame:
        return self.accounts.where(F.col("account_type") == account_type)

    def entries_of(self, status: str) -> DataFrame:
        return self.entries.where(F.col("status") == status)


def money(amount: Column) -> Column:
    """An exact total: amounts are decimals while they are summed, in whatever order they come."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")


def _dated(f: Finance, start: str | None, end: str | None, status: str = "POSTED") -> DataFrame:
    out = f.entries_of(status)
    if start:
        out = out.where(F.col("entry_date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("entry_date") < F.lit(end).cast("date"))
    return out


def _posted(f: Finance, account_type: str | None, amount: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Lines of posted entries in a half-open date range, on accounts of a type.

    The filters and the few columns reach the three scans; the account side is the
    smaller one and is joined first, so fewer lines are shuffled by entry.
    """
    lines = f.lines.select("entry_id", "account_id", "business_unit_id", amount)
    if account_type:
        lines = lines.join(f.accounts_of(account_type), "account_id")
    return lines.join(_dated(f, start, end).select("entry_id", "entry_date"), "entry_id")


def _unit(f: Finance) -> DataFrame:
    return f.units.withColumnRenamed("id", "business_unit_id").withColumnRenamed("name", "business_unit")


def revenue_by_unit(f: Finance, since: str) -> DataFrame:
    """Q1: credit on revenue accounts per unit since a date."""
    per_unit = _posted(f, "REVENUE", "credit_amount", since).groupBy("business_unit_id").agg(money(F.col("credit_amount")).alias("s"))
    return (per_unit.join(_unit(f), "business_unit_id").groupBy("business_unit").agg(money(F.col("s")).alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), "business_unit"))


def over_budget(f: Finance, year: int, quarter: int) -> DataFrame:
    """Q2: unit and account whose spend in a quarter is above budget."""
    start, end = f"{year}-{quarter * 3 - 2:02d}-01", f"{year + quarter // 4}-{quarter % 4 * 3 + 1:02d}-01"
    planned = F.col(f"q{quarter}_amount")
    keys = ["business_unit_id", "account_id"]
    spent = _posted(f, "EXPENSE", "debit_amount", start, end).groupBy(*keys, "account_name").agg(money(F.col("debit_amount")).alias("actual"))
    budget = f.budgets.where(F.col("fiscal_year") == year).select(*keys, planned.alias("budget"))
    return (spent.join(budget, keys).where("actual > budget").join(_unit(f), "business_unit_id")
            .select("business_unit", "account_name", "actual", "budget", F.round(F.col("actual") - F.col("budget"), 2).alias("variance"))
            .orderBy(F.desc("variance"), "business_unit", "account_name"))


def overdue_invoices(f: Finance, above: float, as_of: str) -> DataFrame:
    """Q3: overdue invoices above an amount, with days overdue."""
    due = f.invoices.where((F.col("status") == "OVERDUE") & (F.col("amount") > above))
    return (due.join(_unit(f), "business_unit_id")
            .select("invoice_id", "vendor_name", "amount", F.date_format("due_date", "yyyy-MM-dd").alias("due_date"),
                    F.datediff(F.lit(as_of).cast("date"), "due_date").alias("days_overdue"), "business_unit")
            .orderBy(F.desc("amount"), "invoice_id"))


def monthly_cash_flow(f: Finance, flow_type: str) -> DataFrame:
    """Q4: net movement of a type by month."""
    return (f.cash_flow.where(F.col("flow_type") == flow_type)
            .groupBy(F.date_format(F.date_trunc("month", "flow_date"), "yyyy-MM-dd").alias("month"))
            .agg(money(F.col("amount")).alias("net_cash_flow")).orderBy("month"))


def top_expense_accounts(f: Finance, n: int = 10) -> DataFrame:
    """Q5: accounts with the highest posted expense."""
    return (_posted(f, "EXPENSE", "debit_amount").groupBy("account_id", "account_name")
            .agg(money(F.col("debit_amount")).alias("total_spend")).orderBy(F.desc("total_spend"), "account_id").limit(n))


def quarterly_growth(f: Finance, year: int) -> DataFrame:
    """Q6: revenue by quarter of a year and growth on the quarter before.

    The window has no key, but sees the four rows of the aggregate only.
    """
    quarterly = (_posted(f, "REVENUE", "credit_amount", f"{year}-01-01", f"{year + 1}-01-01")
                 .groupBy(F.quarter("entry_date").alias("quarter")).agg(money(F.col("credit_amount")).alias("revenue")))
    before = F.lag("revenue").over(Window.orderBy("quarter"))
    return (quarterly.withColumn("prev_quarter", before)
            .withColumn("growth_pct", F.round(F.try_divide(F.col("revenue") - F.col("prev_quarter"), F.col("prev_quarter")) * 100, 1))
            .orderBy("quarter"))


def expenses_by_unit(f: Finance, since: str) -> DataFrame:
    """Q7: expense and expense per head of each unit."""
    per_unit = _posted(f, "EXPENSE", "debit_amount", since).groupBy("business_unit_id").agg(money(F.col("debit_amount")).alias("total_expenses"))
    return (per_unit.join(_unit(f), "business_unit_id")
            .select("business_unit", "region", "total_expenses", "head_count",
                    F.round(F.try_divide(F.col("total_expenses"), F.col("head_count")), 2).alias("cost_per_head"))
            .orderBy(F.desc("total_expenses"), "business_unit"))


def pending_entries(f: Finance) -> DataFrame:
    """Q8: entries waiting for approval with their totals, newest first."""
    pending = _dated(f, None, None, "PENDING")
    totals = f.lines.select("entry_id", "debit_amount").groupBy("entry_id").agg(money(F.col("debit_amount")).alias("total_amount"))
    return (pending.join(totals, "entry_id")
            .select("entry_id", F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"), "description", "created_by", "total_amount")
            .orderBy(F.desc("entry_date"), "entry_id"))


def vendor_spend(f: Finance, n: int = 10) -> DataFrame:
    """Q9: vendors by spend, with invoice count and overdue part."""
    return (f.invoices.groupBy("vendor_name")
            .agg(F.count(F.lit(1)).alias("invoice_count"), money(F.col("amount")).alias("total_spend"),
                 money(F.when(F.col("status") == "OVERDUE", F.col("amount")).otherwise(0.0)).alias("overdue_amount"))
            .orderBy(F.desc("total_spend"), "vendor_name").limit(n))


def cost_per_employee(f: Finance, salary_accounts: Column) -> DataFrame:
    """Q10: posted salary cost of each unit per head."""
    lines = f.lines.where(salary_accounts).select("entry_id", "business_unit_id", "debit_amount")
    per_unit = (lines.join(_dated(f, None, None).select("entry_id"), "entry_id")
                .groupBy("business_unit_id").agg(money(F.col("debit_amount")).alias("total_salary_cost")))
    return (per_unit.join(_unit(f), "business_unit_id")
            .select("business_unit", "head_count", "total_salary_cost",
                    F.round(F.try_divide(F.col("total_salary_cost"), F.col("head_count")), 2).alias("cost_per_employee"))
            .orderBy(F.desc("cost_per_employee"), "business_unit"))


def budget_variance(f: Finance, unit: str, year: int) -> DataFrame:
    """Q11: a unit's spend of a year by account against budget; accounts without one stay."""
    mine = _unit(f).where(F.col("business_unit") == unit).select("business_unit_id")
    spent = (_posted(f, "EXPENSE", "debit_amount", f"{year}-01-01", f"{year + 1}-01-01").join(mine, "business_unit_id")
             .groupBy("account_id", "account_name").agg(money(F.col("debit_amount")).alias("actual")))
    total = F.col("q1_amount") + F.col("q2_amount") + F.col("q3_amount") + F.col("q4_amount")
    budget = (f.budgets.where(F.col("fiscal_year") == year).join(mine, "business_unit_id")
              .groupBy("account_id").agg(money(total).alias("budget")))
    variance = F.round(F.col("actual") - F.col("budget"), 2)
    return (spent.join(budget, "account_id", "left")
            .select("account_id", "account_name", "actual", "budget", variance.alias("variance"),
                    F.round(F.try_divide(variance, F.col("budget")) * 100, 1).alias("variance_pct"))
            .orderBy(F.desc("actual"), "account_id"))


class Rental(NamedTuple):
    """Films, their categories and cast, copies, rentals, payments, customers and stores."""

    films: DataFrame      # film_id, title, length, rental_duration, category
    actors: DataFrame     # actor_id, first_name, last_name
    film_actors: DataFrame  # film_id, actor_id
    inventory: DataFrame  # inventory_id, film_id
    rentals: DataFrame    # rental_id, inventory_id, customer_id, rental_date, return_date
    payments: DataFrame   # rental_id, staff_id, amount
    customers: DataFrame  # customer_id, first_name, last_name
    staff: DataFrame      # staff_id, first_name, last_name, email, store_id
    stores: DataFrame     # store_id, city_id
    cities: DataFrame     # city_id, city, country_id
    countries: DataFrame  # country_id, country


def _full_name(first: str = "first_name", last: str = "last_name") -> Column:
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def count_all(df: DataFrame, out: str) -> DataFrame:
    """Q12: how many rows."""
    return df.agg(F.count(F.lit(1)).alias(out))


def top_films(r: Rental, n: int = 5) -> DataFrame:
    """Q13: films by revenue, over copies, rentals and payments.

    Payments are summed per rental and rentals per film before titles are looked up.
    """
    paid = r.payments.select("rental_id", "amount").join(r.rentals.select("rental_id", "inventory_id"), "rental_id")
    per_copy = paid.groupBy("inventory_id").agg(F.sum("amount").alias("s"))
    per_film = per_copy.join(r.inventory, "inventory_id").groupBy("film_id").agg(F.sum("s").alias("s"))
    return (per_film.join(r.films.select("film_id", "title"), "film_id").groupBy("title").agg(money(F.col("s")).alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), "title").limit(n))


def prolific_actors(r: Rental, n: int = 5) -> DataFrame:
    """Q14: actors by number of films; counted before names are joined."""
    per_actor = r.film_actors.groupBy("actor_id").agg(F.count("film_id").alias("film_count"))
    return (per_actor.join(r.actors, "actor_id")
            .select("actor_id", _full_name().alias("actor_name"), "film_count")
            .orderBy(F.desc("film_count"), "actor_id").limit(n))


def films_per_category(r: Rental) -> DataFrame:
    """Q15"""
    return (r.films.groupBy("category").agg(F.count("film_id").alias("film_count")).orderBy(F.desc("film_count"), "category"))


def frequent_customers(r: Rental, more_than: int = 30) -> DataFrame:
    """Q16: customers with more than so many rentals."""
    busy = r.rentals.groupBy("customer_id").agg(F.count("rental_id").alias("rental_count")).where(F.col("rental_count") > more_than)
    return (busy.join(r.customers, "customer_id").select("customer_id", _full_name().alias("customer_name"), "rental_count")
            .orderBy(F.desc("rental_count"), "customer_id"))


def duration_per_category(r: Rental) -> DataFrame:
    """Q17"""
    return (r.films.groupBy("category").agg(F.round(F.avg("rental_duration"), 2).alias("avg_duration_days"))
            .orderBy(F.desc("avg_duration_days"), "category"))


def long_films(r: Rental, minutes: int = 180) -> DataFrame:
    """Q18"""
    return r.films.where(F.col("length") > minutes).select("film_id", "title", "length").orderBy(F.desc("length"), "film_id")


def staff_list(r: Rental) -> DataFrame:
    """Q19"""
    return r.staff.select("staff_id", _full_name().alias("staff_name"), "email", "store_id")


def revenue_by_store(r: Rental) -> DataFrame:
    """Q20: revenue of each store with its place; six tables.

    Payments are first summed per staff member, so the chain of joins carries one
    row each instead of every payment.
    """
    per_staff = r.payments.groupBy("staff_id").agg(F.sum("amount").alias("s"))
    place = F.concat(F.col("city"), F.lit(", "), F.col("country"))
    return (per_staff.join(r.staff.select("staff_id", "store_id"), "staff_id")
            .join(r.stores, "store_id").join(r.cities, "city_id").join(r.countries, "country_id")
            .groupBy("store_id", place.alias("location")).agg(money(F.col("s")).alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), "store_id"))


def rental_history(r: Rental, first: str, last: str, n: int = 10) -> DataFrame:
    """Q21: the latest rentals of a named customer."""
    who = r.customers.where((F.col("first_name") == first) & (F.col("last_name") == last)).select("customer_id")
    stamp = "yyyy-MM-dd HH:mm:ss"
    rented = r.rentals.join(who, "customer_id").join(r.inventory, "inventory_id").join(r.films.select("film_id", "title"), "film_id")
    return (rented.orderBy(F.desc("rental_date"), F.desc("rental_id"), "title").limit(n)
            .select("rental_id", "title", F.date_format("rental_date", stamp).alias("rental_date"), F.date_format("return_date", stamp).alias("return_date")))


def average_by(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Q22: the plain average per group."""
    return df.groupBy(group).agg(F.round(F.avg(value), 4).alias(out)).orderBy(group)


def counted_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """Q23: a subplan that is named and then selected from."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).orderBy(group)


def having_related(df: DataFrame, related: DataFrame, key: str, related_key: str) -> DataFrame:
    """Q24: rows whose key is among another query's; a semi-join."""
    return df.join(related.select(F.col(related_key).alias(key)).distinct(), key, "left_semi")


def previous_month(df: DataFrame, date: str, as_of: str) -> DataFrame:
    """Q25: rows of the calendar month before a date, as a range the scan can use."""
    day = F.lit(as_of).cast("date")
    end = F.trunc(day, "month")
    return df.where((F.col(date) >= F.add_months(end, -1)) & (F.col(date) < end))


def top_customers(orders: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    """Q26: customers by spend, with the amount as text."""
    spend = orders.groupBy("customer_id").agg(money(F.col("amount")).alias("total_spend"))
    return (spend.join(customers, "customer_id").orderBy(F.desc("total_spend"), "customer_id").limit(n)
            .select("customer_id", "name", "total_spend", currency("total_spend").alias("total_spend_text")))
