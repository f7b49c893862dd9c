"""A made-up household ledger for tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories with their usual cents, one a day from the 1st; fixed values.
CATEGORIES = [
    ("Mortgage", 110000), ("Electricity", 10000), ("Natural gas", 6000), ("Municipal payments", 3500), ("Groceries & meal kits", 48000), ("Dining & drinks", 18000),
    ("Shopping & mixed retail", 16000), ("Fuel & charging", 12000), ("Vehicle care & registration", 4500), ("Pets", 6500), ("Home & hardware", 8000), ("Medical & pharmacy", 2500),
    ("Dental", 3000), ("Travel & parking", 5000), ("Apps & subscriptions", 3500), ("Entertainment", 4000), ("Vision", 1500), ("Uncategorized / review", 2000),
]
#: Rows of every month besides: day, category, cents, kind, merchant; fixed values.
OTHERS = [
    (20, "Shopping & mixed retail", -1500, "spend", "Sample Shopping & mixed retail Merchant"),
    (21, "Payroll", 300000, "income", "Sample Employer A"),
    (22, "Card repayment", 90000, "card_payment", "Sample Card Provider"),
    (23, "Internal transfer", 10000, "transfer", "Sample Savings Transfer"),
    (24, "Investment funding", 5000, "investment", "Sample Investment Transfer"),
    (25, "Store-card payment", 4000, "debt_payment", "Sample Store Card"),
]
BANK = ("Mortgage", "Electricity", "Natural gas", "Municipal payments")
FIRST_MONTH, MONTHS, FIRST_COVERED = 2029 * 12 + 9, 24, 2030 * 12


def months(spark: SparkSession, n: int = MONTHS) -> DataFrame:
    """The calendar: month_idx and whether it is covered."""
    return spark.range(n).select((F.col("id") + FIRST_MONTH).cast("int").alias("month_idx")).withColumn("covered", F.col("month_idx") >= FIRST_COVERED)


def ledger(spark: SparkSession, n: int = MONTHS) -> DataFrame:
    """24 rows for each of n months, from the calendar and the row templates alone."""
    lines = [(k + 1, d, c, a, "spend", f"Sample {c} Merchant", False) for k, (d, (c, a)) in enumerate(enumerate(CATEGORIES, 1))]
    lines += [(len(CATEGORIES) + 1 + k, *o, True) for k, o in enumerate(OTHERS)]
    template = spark.createDataFrame(lines, "line int, day int, category string, base long, kind string, merchant string, other boolean")
    i = F.col("month_idx") - FIRST_MONTH
    at = lambda y, m: F.col("month_idx") == y * 12 + m - 1
    episode, trip, tools = at(2031, 9) & (F.col("category") == "Dental"), at(2031, 8) & (F.col("category") == "Travel & parking"), at(2031, 7) & (F.col("category") == "Home & hardware")
    shop = (F.col("category") == "Shopping & mixed retail") & ~F.col("other")
    revised = F.col("category").isin("Dental", "Vision")
    usual = F.when(F.col("other") | (F.col("category") == "Mortgage"), F.col("base")).otherwise(F.col("base") + (i % 3 - 1) * 100)
    flags = [(episode, "nonroutine_dental_episode"), (trip, "reimbursement_candidate"), (tools, "business_candidate"), (shop, "mixed_retail"), (revised, "source_category_revised")]
    rows = months(spark, n).crossJoin(F.broadcast(template))
    number = i * F.lit(len(lines)) + F.col("line")
    unsure = F.col("category") == "Uncategorized / review"
    rows = rows.withColumns(
        {
            "id": F.concat(F.lit("sample-"), F.lpad(number.cast("string"), 4, "0")),
            "date": F.make_date(F.floor(F.col("month_idx") / 12).cast("int"), F.col("month_idx") % 12 + 1, "day"),
            "amount_cents": F.when(episode, 45000).when(trip, 24000).otherwise(usual).cast("long"),
            "source_category": F.when(revised, "Health").otherwise(F.col("category")),
            "source": F.when((F.col("other") & (F.col("kind") != "spend")) | F.col("category").isin(*BANK), "sample-bank").otherwise("sample-card"),
            "confidence": F.when(unsure, "low").otherwise("high"),
            "flags": F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in flags])),
            "note": F.lit("Invented fixture record; no real purchase or person."),
            "income_type": F.when(F.col("kind") == "income", "observed_payroll_deposit"),
            "classification_changed": revised,
            "evidence_summary": F.lit("Synthetic evidence demonstrates the record-review interface."),
            "needs_category_review": unsure,
            "needs_item_review": F.col("category") == "Shopping & mixed retail",
            "source_row": number.cast("int"),
        }
    )
    rows = rows.withColumn("direction", F.when((F.col("kind") == "income") | (F.col("amount_cents") < 0), "inbound").otherwise("outbound"))
    return rows.withColumn("needs_scope_review", trip | tools).drop("line", "day", "base", "other")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("sample-bank", "Sample bank fixture"), ("sample-card", "Sample card fixture")], "id string, label string")
