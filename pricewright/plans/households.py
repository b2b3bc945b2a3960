"""Queries over the household ledger, in whole cents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricewright.plans.registry import query
from pricewright.sources.domain import Domain

SPLIT_SQL = """
member AS (SELECT household_id, user_id, row_number() OVER (PARTITION BY household_id ORDER BY user_id) - 1 AS at, count(*) OVER (PARTITION BY household_id) AS n FROM person),
bill AS (SELECT r.receipt_id, p.household_id, r.user_id AS payer, r.cents FROM receipt r JOIN person p USING (user_id)),
share AS (SELECT b.receipt_id, b.household_id, b.payer, b.cents, m.user_id, b.cents // m.n + CASE WHEN (m.at - b.receipt_id % m.n + m.n) % m.n < b.cents % m.n THEN 1 ELSE 0 END AS share FROM bill b JOIN member m USING (household_id))"""
BALANCE_SQL = SPLIT_SQL + """,
delta AS (SELECT household_id, payer AS user_id, cents AS delta FROM bill WHERE household_id IN (SELECT household_id FROM member) UNION ALL SELECT household_id, user_id, -share FROM share),
balance AS (SELECT household_id, user_id, sum(delta)::BIGINT AS cents FROM delta GROUP BY ALL)"""


def shares(d: Domain):
    """Every bill's whole cents over the members, the odd cents going round with the receipt's number."""
    order = Window.partitionBy("household_id").orderBy("user_id")
    members = d.user.select("household_id", "user_id").withColumn("at", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("household_id")))
    bills = d.receipt.join(d.user.select("user_id", "household_id"), "user_id").select("receipt_id", "household_id", F.col("user_id").alias("payer"), "cents")
    odd = F.when(F.pmod(F.col("at") - F.col("receipt_id") % F.col("n"), F.col("n")) < F.col("cents") % F.col("n"), 1).otherwise(0)
    return bills.join(members, "household_id").select("receipt_id", "household_id", "payer", "cents", "user_id", (F.expr("cents div n") + odd).alias("share")), bills, members


def balances(d: Domain):
    split, bills, members = shares(d)
    paid = bills.join(members.select("household_id").distinct(), "household_id", "left_semi").select("household_id", F.col("payer").alias("user_id"), F.col("cents").alias("delta"))
    return paid.unionByName(split.select("household_id", "user_id", (-F.col("share")).alias("delta"))).groupBy("household_id", "user_id").agg(F.sum("delta").alias("cents"))


@query("led01_split_shares", SPLIT_SQL + " SELECT receipt_id, user_id, share FROM share")
def led01(d: Domain):
    return shares(d)[0].select("receipt_id", "user_id", "share")


@query("led02_balances", BALANCE_SQL + " SELECT household_id, user_id, cents FROM balance")
def led02(d: Domain):
    return balances(d)


@query("led02_zero_sum", BALANCE_SQL + " SELECT household_id, sum(cents)::BIGINT AS total FROM balance GROUP BY household_id")
def led02_zero(d: Domain):
    return balances(d).groupBy("household_id").agg(F.sum("cents").alias("total"))


@query("led03_next_shopper", BALANCE_SQL + " SELECT household_id, user_id FROM balance QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY cents, user_id) = 1")
def led03(d: Domain):
    return balances(d).groupBy("household_id").agg(F.min_by("user_id", F.struct("cents", "user_id")).alias("user_id"))


@query("led04_debts_of_next_shopper", BALANCE_SQL + """,
debtor AS (SELECT * FROM balance QUALIFY row_number() OVER (PARTITION BY household_id ORDER BY cents, user_id) = 1),
creditor AS (SELECT household_id, user_id, cents, sum(cents) OVER (PARTITION BY household_id ORDER BY cents DESC, user_id) - cents AS before FROM balance WHERE cents > 0)
SELECT c.household_id, d.user_id AS from_user, c.user_id AS to_user, least(c.cents, greatest(0, -d.cents - c.before))::BIGINT AS cents FROM creditor c JOIN debtor d USING (household_id) WHERE least(c.cents, greatest(0, -d.cents - c.before)) > 0""")
def led04(d: Domain):
    b = balances(d)
    debtor = b.groupBy("household_id").agg(F.min(F.struct("cents", "user_id")).alias("d"))
    owed = b.where("cents > 0")
    before = F.sum("cents").over(Window.partitionBy("household_id").orderBy(F.desc("cents"), "user_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cents")
    part = F.least(F.col("cents"), F.greatest(F.lit(0), -F.col("d.cents") - F.col("before")))
    return owed.withColumn("before", before).join(debtor, "household_id").select("household_id", F.col("d.user_id").alias("from_user"), F.col("user_id").alias("to_user"), part.alias("cents")).where("cents > 0")


@query("led05_lapsed_settlements", """
SELECT receipt_id, status, CASE WHEN status = 'F' THEN 'confirmed' WHEN day + 7 <= DATE '2001-07-15' THEN 'lapsed' ELSE 'open' END AS state FROM receipt WHERE day >= DATE '2001-06-01'""")
def led05(d: Domain):
    late = F.date_add("day", 7) <= F.lit("2001-07-15").cast("date")
    return d.receipt.where(F.col("day") >= F.lit("2001-06-01").cast("date")).select("receipt_id", "status", F.when(F.col("status") == "F", "confirmed").when(late, "lapsed").otherwise("open").alias("state"))


@query("led07_family_subtotals", "SELECT receipt_id, sum(CASE WHEN line_no % 2 = 0 THEN CAST(floor(price * quantity * 100 + 0.5) AS BIGINT) ELSE 0 END)::BIGINT AS family_cents, sum(CAST(floor(price * quantity * 100 + 0.5) AS BIGINT))::BIGINT AS cents FROM price GROUP BY receipt_id")
def led07(d: Domain):
    cents = F.floor(F.col("price") * F.col("quantity") * 100 + 0.5)
    return d.price.groupBy("receipt_id").agg(F.sum(F.when(F.col("line_no") % 2 == 0, cents).otherwise(0)).alias("family_cents"), F.sum(cents).alias("cents"))


@query("led08_history_page", "SELECT receipt_id, CAST(day AS VARCHAR) AS day, status FROM receipt WHERE receipt_id < 9000 AND user_id % 2 = 0 ORDER BY receipt_id DESC LIMIT 21")
def led08(d: Domain):
    return d.receipt.where("receipt_id < 9000 and user_id % 2 = 0").orderBy(F.desc("receipt_id")).limit(21).select("receipt_id", F.col("day").cast("string").alias("day"), "status")


@query("led09_restatement_guard", "SELECT receipt_id, line_no, count(*) AS seen, min(id) AS kept FROM price GROUP BY receipt_id, line_no HAVING count(*) > 1")
def led09(d: Domain):
    return d.price.groupBy("receipt_id", "line_no").agg(F.count("*").alias("seen"), F.min("id").alias("kept")).where("seen > 1")


@query("rm15_pending_settlements", """
SELECT r.receipt_id FROM receipt r WHERE r.status = 'O' AND r.day < DATE '1999-01-01' AND NOT EXISTS (SELECT 1 FROM receipt c WHERE c.user_id = r.user_id AND c.status = 'F' AND c.day > r.day)""")
def rm15(d: Domain):
    settled = d.receipt.where("status = 'F'").groupBy("user_id").agg(F.max("day").alias("settled"))
    open_ = d.receipt.where("status = 'O'").where(F.col("day") < F.lit("1999-01-01").cast("date")).join(settled, "user_id", "left")
    return open_.where("settled is null or settled <= day").select("receipt_id")


@query("rm16_settlement_lock", """
SELECT r.receipt_id, EXISTS (SELECT 1 FROM receipt c WHERE c.user_id = r.user_id AND c.status = 'F' AND (c.day > r.day OR (c.day = r.day AND c.receipt_id > r.receipt_id))) AS locked FROM receipt r""")
def rm16(d: Domain):
    last = d.receipt.where("status = 'F'").groupBy("user_id").agg(F.max(F.struct("day", "receipt_id")).alias("last"))
    return d.receipt.join(last, "user_id", "left").select("receipt_id", F.coalesce(F.col("last") > F.struct("day", "receipt_id"), F.lit(False)).alias("locked"))


@query("mth02_money_rounding", "SELECT sp_id, floor(list_price * 1.05 * 100 + 0.5) / 100 AS gross FROM sp")
def mth02(d: Domain):
    from pricewright.functions.units import money

    return d.sp.select("sp_id", money(F.col("list_price") * 1.05).alias("gross"))
