"""Scenarios derived from the customer table, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.definitions import TARGETS, Target
from ledgerloom.sources.driver_tables import table

#: The targets that the derived scenarios set, as SQL over k, the customer's key.
TARGET_SQL = {
    "mortgage": "1100 + k % 100",
    "groceries": "CASE WHEN k % 23 = 0 THEN NULL ELSE 500 + k % 40 END",
    "medical": "50 + k % 30",
    "dental": "CASE WHEN k % 29 = 0 THEN NULL ELSE 75 END",
    "storeCard": "40",
    "vehicleA": "180 + k % 9",
    "student": "CASE WHEN k % 31 = 0 THEN NULL ELSE 220 END",
    "vehicleB": "300 + k % 7",
}
PLAN_TARGETS: tuple[Target, ...] = tuple(t for t in TARGETS if t.key in TARGET_SQL)

FIELD_SQL = {
    "scenario_id": "k",
    "plan_mode": "CASE WHEN k % 2 = 0 THEN 'joint' ELSE 'household' END",
    "health_mode": "CASE WHEN k % 4 < 2 THEN 'combined' ELSE 'separate' END",
    "income_basis": "CASE WHEN k % 3 = 0 THEN 'average' ELSE 'regular' END",
    "vehicle_b_funding": "CASE k % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'joint' ELSE 'personal' END",
    "person_a_frequency": "CASE k % 6 WHEN 0 THEN 'weekly' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'semimonthly' WHEN 3 THEN 'monthly' WHEN 4 THEN 'biweekly' ELSE '' END",
    "person_b_frequency": "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'weekly' WHEN 2 THEN 'semimonthly' ELSE 'monthly' END",
    "person_a_pay": "CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal) / 2 END",
    "person_b_pay": "CASE WHEN k % 11 = 0 THEN NULL ELSE 1000 + (k % 50) * 20 END",
    "person_a_allocation": "CASE WHEN k % 13 = 0 THEN NULL ELSE 100 + k % 300 END",
    "person_b_contribution": "CASE WHEN k % 17 = 0 THEN NULL ELSE 500 + (k % 10) * 100 END",
    "other_income": "CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 20) * 10 END",
    "other_expenses": "CASE WHEN k % 19 = 0 THEN NULL ELSE k % 90 END",
    "childcare": "CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 4) * 300 END",
    "baby_costs": "(k % 3) * 100",
    "leave_reduction": "CASE WHEN k % 9 = 0 THEN NULL ELSE (k % 5) * 50 END",
    "home_fund": "100",
    "emergency_fund": "CASE WHEN k % 21 = 0 THEN NULL ELSE (k % 6) * 40 END",
    "anniversary_fund": "50",
    "other_savings": "k % 10",
    "current_cash": "CASE WHEN k % 25 = 0 THEN NULL ELSE k % 6000 END",
    "cash_goal": "5000",
}
FORECAST_SQL = {
    "start": "'2031-10'",
    "months": "12 + k % 25",
    "baby_start": "CASE WHEN k % 2 = 0 THEN '2032-02' ELSE '' END",
    "childcare_start": "'2032-04'",
    "leave_start": "CASE WHEN k % 8 = 0 THEN '' ELSE '2032-02' END",
    "leave_months": "k % 4",
    "income_growth": "CASE WHEN k % 10 = 0 THEN 2 ELSE 0 END",
    "expense_growth": "CASE WHEN k % 15 = 0 THEN 3 ELSE 0 END",
    "cash_yield": "CASE WHEN k % 4 = 0 THEN 5 ELSE 0 END",
}
ONCE_AMOUNT, ONCE_MONTH = "CASE WHEN k % 14 = 0 THEN NULL ELSE 900 + k % 100 END", "CASE WHEN k % 12 = 0 THEN '' ELSE '2032-01' END"
DEBT_END = "CASE WHEN k % 3 = 0 THEN '2031-12' ELSE '' END"

_TEXT = {"plan_mode", "health_mode", "income_basis", "vehicle_b_funding", "person_a_frequency", "person_b_frequency"}


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario for each customer.

    A scenario's months are far more work than its row's bytes show, and a table of many customers may be a
    single row group: the keys are dealt to all tasks before anything is made of them. With a number given, these
    parts aren't put together again for being small.
    """
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    own = [F.expr(sql).cast("long" if c == "scenario_id" else "string" if c in _TEXT else "double").alias(c) for c, sql in FIELD_SQL.items()]
    targets = F.create_map(*[x for k, sql in TARGET_SQL.items() for x in (F.lit(k), F.expr(sql).cast("double"))])
    kinds = {"months": "int", "leave_months": "int", "income_growth": "double", "expense_growth": "double", "cash_yield": "double"}
    once = F.array(F.struct(F.lit("Home repair").alias("label"), F.expr(ONCE_AMOUNT).cast("double").alias("amount"), F.expr(ONCE_MONTH).alias("month")))
    forecast = F.struct(*[F.expr(sql).cast(kinds.get(c, "string")).alias(c) for c, sql in FORECAST_SQL.items()], once.alias("oneoffs"), F.create_map(F.lit("storeCard"), F.expr(DEBT_END)).alias("debt_ends"))
    return rows.select(*own, targets.alias("targets"), forecast.alias("forecast"))


#: Saved documents of the derived scenarios, as SQL over k: what each embeds, and what a later save has.
EMBEDDED_SQL = """concat('{"version": ', CASE k % 5 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN 'null' WHEN 3 THEN '"1"' ELSE '4' END,
    ', "personAPay": ', CASE k % 6 WHEN 0 THEN '"abc"' WHEN 1 THEN 'null' WHEN 2 THEN '""' WHEN 3 THEN '-1' WHEN 4 THEN 'true' ELSE concat(CAST(k % 700 AS VARCHAR(9)), '.5') END,
    ', "targets": {"dining": ', CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"9"' WHEN 2 THEN '125' ELSE '-2' END, CASE WHEN k % 3 = 0 THEN '' ELSE ', "medical": 150, "dental": 20' END,
    '}, "healthMode": ', CASE k % 7 WHEN 0 THEN '"combined"' WHEN 1 THEN '"separate"' WHEN 2 THEN 'null' ELSE '"both"' END,
    ', "forecast": {"months": ', CASE k % 8 WHEN 0 THEN '500' WHEN 1 THEN '12' WHEN 2 THEN '12.5' WHEN 3 THEN 'null' WHEN 4 THEN '"24"' ELSE '60' END,
    ', "babyStart": ', CASE k % 4 WHEN 0 THEN '"2032-02"' WHEN 1 THEN '"2032-13"' WHEN 2 THEN '""' ELSE 'null' END, ', "cashYield": 4}',
    ', "checks": {"income": ', CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' ELSE 'false' END, '}, "adjustments": {"airfare": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE '1' END, '}, "tab": "plan"}')"""
SAVED_SQL = """CASE WHEN k % 11 = 0 THEN 'no document' WHEN k % 13 = 0 THEN '[1, 2]' ELSE concat('{"version": ', CASE WHEN k % 2 = 0 THEN '4' ELSE '2' END,
    ', "otherIncome": ', CASE k % 3 WHEN 0 THEN '""' WHEN 1 THEN '70' ELSE '"70"' END, CASE WHEN k % 4 = 0 THEN ', "personAPay": 2500' ELSE '' END,
    ', "targets": ', CASE k % 5 WHEN 0 THEN '3' WHEN 1 THEN '{"medical": 90}' ELSE '{"student": null}' END,
    ', "forecast": ', CASE k % 6 WHEN 0 THEN 'null' WHEN 1 THEN '{"oneoffs": "none", "debtEnds": {"student": "2031-12"}}' ELSE concat('{"oneoffs": [{"label": ', CASE WHEN k % 4 = 1 THEN '""' ELSE '"Roof"' END, ', "amount": ', CAST(k % 90 - 9 AS VARCHAR(9)), ', "month": "2032-01"}, 5], "debtEnds": {"student": "2031-13", "boat": "2031-12"}}') END,
    ', "tab": ', CASE k % 3 WHEN 0 THEN '"review"' ELSE '"home"' END, ', "auditBudgetNotice": ', CASE WHEN k % 5 = 4 THEN 'false' ELSE '0' END, '}') END"""
FORECAST_START = "2031-10"


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The embedded documents of all customers, and the saved ones of two thirds of them: (scenario_id, json)."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    made = lambda sql: F.expr(sql).alias("json")
    return rows.select(F.col("k").alias("scenario_id"), made(EMBEDDED_SQL)), rows.filter("k % 3 <> 0").select(F.col("k").alias("scenario_id"), made(SAVED_SQL))
