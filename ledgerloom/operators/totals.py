"""Totals, groups, pages and shares of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import js_round
from ledgerloom.operators.predicates import evidence_text, filtered, flag, LedgerQuery, matches_kind, matches_review, named, removed
from ledgerloom.operators.ranges import at_positions, ranked


def _cents(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def spend(df: DataFrame) -> DataFrame:
    return df.filter(F.col("kind") == "spend")


def category_totals(df: DataFrame, q: LedgerQuery) -> DataFrame:
    """Spending by category without what the adjustments remove, largest first: category, total_cents, rows."""
    rows = spend(filtered(df, q)).filter(~removed(q))
    out = rows.groupBy(named(q.basis).alias("category")).agg(F.sum("amount_cents").cast("long").alias("total_cents"), F.count(F.lit(1)).alias("rows"))
    return out.orderBy(F.col("total_cents").desc(), "category")


def summary(df: DataFrame, q: LedgerQuery) -> DataFrame:
    """One row: rows of all kinds, spending, adjusted and adjustment in cents."""
    own, gone = F.col("kind") == "spend", removed(q)
    amount = F.col("amount_cents")
    return filtered(df, q).agg(
        F.count(F.lit(1)).alias("rows"),
        _cents(F.when(own, amount)).alias("spending_cents"),
        _cents(F.when(own & ~gone, amount)).alias("adjusted_cents"),
        _cents(F.when(own & gone, amount)).alias("adjustment_cents"),
    )


def counters(df: DataFrame, q: LedgerQuery) -> DataFrame:
    """One row: how many rows are listed, unresolved and changed."""
    rows = filtered(df, q)
    return rows.filter(matches_kind(q.kind)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(matches_review(rows, "unresolved")).alias("unresolved"), F.count_if(matches_review(rows, "changed")).alias("changed"))


def merchant_groups(df: DataFrame, basis: str = "category") -> DataFrame:
    """Spending by category and merchant: totals, counts, rows to review, both levels largest first.

    Merchants are ranked in ranges of their totals, so that no category is one task's work.
    """
    rows = spend(df)
    flat = rows.groupBy(named(basis).alias("category"), "merchant").agg(F.sum("amount_cents").cast("long").alias("total_cents"), F.count(F.lit(1)).alias("rows"), F.count_if(matches_review(rows, "unresolved")).alias("review_rows"))
    own = flat.groupBy("category").agg(F.sum("total_cents").cast("long").alias("category_cents"), F.sum("rows").cast("long").alias("category_rows")).withColumnRenamed("category", "__of")
    whole = ranked(flat, "category", "total_cents", "merchant", "place").join(own, F.col("category") == F.col("__of"))
    return whole.select("category", "category_cents", "category_rows", "merchant", "total_cents", "rows", "review_rows", "place")


def nested_merchant_groups(df: DataFrame, basis: str = "category") -> DataFrame:
    """The same with each category's merchants as one sorted array."""
    flat = merchant_groups(df, basis)
    item = F.struct("place", "merchant", "total_cents", "rows", "review_rows")
    out = flat.groupBy("category", "category_cents", "category_rows").agg(F.array_sort(F.collect_list(item)).alias("merchants"))
    return out.orderBy(F.col("category_cents").desc(), "category")


def grouping_sets(df: DataFrame, basis: str = "category") -> DataFrame:
    """Categories and their merchants in one pass; a category's own row has no merchant."""
    rows = spend(df).select(named(basis).alias("category"), F.col("merchant"), "amount_cents")
    both = rows.groupingSets([["category"], ["category", "merchant"]], "category", "merchant")
    out = both.agg(F.grouping("merchant").cast("int").alias("is_total"), F.sum("amount_cents").cast("long").alias("total_cents"), F.count(F.lit(1)).alias("rows"))
    return out.select("category", "merchant", "is_total", "total_cents", "rows")


def drill_rows(df: DataFrame, basis: str = "category") -> DataFrame:
    """The spending rows behind the merchants of every category, latest first, with what a reader sees of them.

    One sort of the rows; a merchant with many of them is split over ranges of dates and ids.
    """
    own = df.filter(F.col("kind") == "spend")
    shown = own.select(
        named(basis).alias("category"), "merchant", "date", "id", "amount_cents",
        F.when(F.col("amount_cents") < 0, "Refund").otherwise("").alias("mark"),
        F.coalesce(flag("nonroutine_dental_episode"), F.lit(False)).alias("nonroutine"),
        evidence_text("Category follows the supplied source label. Item contents are not available.").alias("evidence"),
        F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.lit("Unreviewed")).alias("confidence"),
    )
    return shown.orderBy("category", "merchant", F.col("date").desc(), "id")


def month_drill(df: DataFrame, q: LedgerQuery) -> DataFrame:
    """Spending by month, newest first, without what the adjustments remove."""
    rows = spend(filtered(df, q)).filter(~removed(q))
    return rows.groupBy("month_idx").agg(F.sum("amount_cents").cast("long").alias("total_cents"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("month_idx").desc())


def page(df: DataFrame, order: list[Column], number: int, size: int = 30, parts: list[tuple[Column, bool]] | None = None, most: int = 100_000) -> DataFrame:
    """Page `number` from 1 of the sorted rows; past the end, the last page.

    With `parts`, coarse columns that follow the order, a page costs the same at any depth (`ranges.at_positions`).
    """
    n = df.count()
    last = max(1, -(-n // size))
    return at_positions(df, order, parts or [], (min(max(number, 1), last) - 1) * size, size, most)


def top_and_other(totals: DataFrame, n: int, other: str = "All other categories") -> DataFrame:
    """The n largest categories and the sum of the rest; zero totals don't count, n = 0 keeps all.

    The ranking is over categories, a small table, not over ledger rows.
    """
    full = totals.filter("total_cents != 0")
    if not n:
        return full.select("category", "total_cents")
    ranked = full.withColumn("place", F.row_number().over(Window.orderBy(F.col("total_cents").desc(), "category")))
    return ranked.groupBy(F.when(F.col("place") <= n, F.col("category")).otherwise(F.lit(other)).alias("category")).agg(F.sum("total_cents").cast("long").alias("total_cents"))


def share_of_largest(totals: DataFrame) -> DataFrame:
    """Each total's share of the largest absolute one, in tenths of a percent, 0 to 1000."""
    largest = totals.agg(F.greatest(F.max(F.abs("total_cents")), F.lit(1)).alias("largest"))
    share = F.expr(js_round("greatest(CAST(0 AS DOUBLE), least(CAST(1000 AS DOUBLE), CAST(total_cents AS DOUBLE) * 1000 / largest))"))
    return totals.crossJoin(F.broadcast(largest)).select("category", "total_cents", share.alias("share_permille"))


def kind_sums(df: DataFrame, kinds: list[str]) -> DataFrame:
    """One row with a sum for each kind."""
    return df.agg(*[_cents(F.when(F.col("kind") == k, F.col("amount_cents"))).alias(f"{k}_cents") for k in kinds])


def flag_sums(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row with the spending under each flag."""
    own = F.col("kind") == "spend"
    return df.agg(*[_cents(F.when(own & flag(f), F.col("amount_cents"))).alias(f"{f}_cents") for f in flags])


def payroll(df: DataFrame, divisor: int) -> DataFrame:
    """One row: observed payroll, and adjusted spending per month."""
    pay = (F.col("kind") == "income") & (F.col("income_type") == "observed_payroll_deposit")
    one = df.agg(_cents(F.when(pay, F.col("amount_cents"))).alias("payroll_cents"), _cents(F.when(F.col("kind") == "spend", F.col("amount_cents"))).alias("spending_cents"))
    return one.withColumn("average_cents", F.expr(js_round(f"(CAST(spending_cents AS DOUBLE) / {int(divisor)})")))


def unresolved_merchants(df: DataFrame) -> DataFrame:
    """Merchants with spending whose category is open: rows and total, largest first."""
    rows = spend(df).filter(F.coalesce("needs_category_review", F.lit(False)))
    return rows.groupBy("merchant").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_cents").cast("long").alias("total_cents")).orderBy(F.col("total_cents").desc(), "merchant")


def category_list(df: DataFrame, basis: str = "category") -> DataFrame:
    """The categories that have spending."""
    return spend(df).select(F.col(basis).alias("category")).distinct().orderBy("category")


def prior_year(df: DataFrame, year: int, through_month: int) -> DataFrame:
    """One row: spending of a year's first months, the same of the year before, and the change in basis points.

    The change is null unless the earlier spending is above zero.
    """
    ym = lambda y: (F.col("month_idx") >= y * 12) & (F.col("month_idx") < y * 12 + through_month)
    own = spend(df).filter((F.col("month_idx") >= (year - 1) * 12) & (F.col("month_idx") < year * 12 + through_month))
    one = own.agg(_cents(F.when(ym(year), F.col("amount_cents"))).alias("now_cents"), _cents(F.when(ym(year - 1), F.col("amount_cents"))).alias("prior_cents"))
    change = F.expr(js_round("((CAST(now_cents AS DOUBLE) / CAST(prior_cents AS DOUBLE) - 1) * 10000)"))
    return one.withColumn("change_bp", F.when(F.col("prior_cents") > 0, change))
