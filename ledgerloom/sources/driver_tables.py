"""The ledger as a view of the star schema.

Only the tables that the asked columns need are joined, and a period goes to the scan as
bounds on the raw ship date, so that it is pushed down. Left joins keep every line; all
keys are the dimensions' own.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns by the table they come from; fixed values.
_FROM_LINE = {
    "id": "concat(l_orderkey, '-', l_linenumber)",
    "date": "CAST(l_shipdate AS DATE)",
    "month_idx": "year(l_shipdate) * 12 + month(l_shipdate) - 1",
    "source": "l_linestatus",
    "amount_cents": "(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(round(l_extendedprice * 100) AS BIGINT)",
    "flags": "array_compact(array(CASE WHEN l_discount >= 0.1D THEN 'reimbursement_candidate' END, CASE WHEN l_tax >= 0.08D THEN 'business_candidate' END,"
    " CASE WHEN l_quantity >= 49 THEN 'nonroutine_dental_episode' END, CASE WHEN l_quantity <= 2 THEN 'source_category_revised' END))",
    "direction": "CASE WHEN l_returnflag = 'R' THEN 'inbound' ELSE 'outbound' END",
    "confidence": "CASE WHEN l_tax < 0.01D THEN 'provisional' WHEN l_tax < 0.04D THEN 'medium' ELSE 'high' END",
    "needs_category_review": "l_tax < 0.005D",
    "needs_item_review": "l_discount < 0.01D",
    "needs_scope_review": "false",
    "classification_changed": "l_quantity <= 1",
    "evidence_basis": "CASE WHEN l_quantity <= 3 THEN 'receipt' ELSE 'synthetic_fixture' END",
}
_FROM = {
    "merchant": ("supplier", "l_suppkey", "s_suppkey", "s_name"),
    "category": ("part", "l_partkey", "p_partkey", "p_type"),
    "source_category": ("part", "l_partkey", "p_partkey", "p_brand"),
    "kind": ("orders", "l_orderkey", "o_orderkey", "CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'card_payment' WHEN '5-LOW' THEN 'income' ELSE 'spend' END"),
    "income_type": ("orders", "l_orderkey", "o_orderkey", "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'observed_payroll_deposit' END"),
    "note": ("customer", "o_custkey", "c_custkey", "c_mktsegment"),
}
COLUMNS = [*_FROM_LINE, *_FROM]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """The ledger's rows with the asked columns, from start up to but without end."""
    columns = columns or COLUMNS
    rows = table(spark, sf_dir, "lineitem")
    for bound, test in ((start, F.col("l_shipdate").__ge__), (end, F.col("l_shipdate").__lt__)):
        if bound is not None:
            rows = rows.filter(test(F.expr(f"TIMESTAMP_NTZ '{bound} 00:00:00'")))
    needed = {_FROM[c][0] for c in columns if c in _FROM}
    if "customer" in needed:
        needed.add("orders")
    for name, key, own in (("orders", "l_orderkey", "o_orderkey"), ("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"), ("customer", "o_custkey", "c_custkey")):
        if name in needed:
            other = table(spark, sf_dir, name)
            rows = rows.join(other, F.col(key) == F.col(own), "left")
    return rows.select(*[F.expr(_FROM_LINE[c] if c in _FROM_LINE else _FROM[c][3]).alias(c) for c in columns])


def coverage(spark: SparkSession, sf_dir: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """The months that have lines, in a period or in all, and whether each is covered (every seventh isn't)."""
    months = ledger(spark, sf_dir, ["month_idx"], start, end).groupBy("month_idx").agg(F.count(F.lit(1)).alias("rows"))
    return months.select("month_idx", (F.col("month_idx") % 7 != 0).alias("covered"))


def sources(spark: SparkSession) -> DataFrame:
    """Labels of the two sources."""
    return spark.createDataFrame([("O", "Open lines"), ("F", "Filled lines")], "id string, label string")
