"""Rollups by month, baseline, source and audit, and the targets' observed averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import js_round, money, pretty
from ledgerloom.operators.predicates import flag, named


def _when(c: Column, sign: int = 1) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col("amount_cents") * sign)), F.lit(0)).cast("long")


def _measures(card: str, bank: str, counted: bool = False) -> dict[str, Column]:
    """Every measure of a month, in one pass. counted: rows are partial sums and say of how many rows."""
    own = F.col("kind") == "spend"
    return {
        "transaction_count": F.sum("rows").cast("long") if counted else F.count(F.lit(1)),
        "spending_cents": _when(own),
        "payroll_cents": _when(F.col("kind") == "income"),
        "debt_payments_cents": _when(F.col("kind") == "debt_payment"),
        "investment_cents": _when(F.col("kind") == "investment"),
        "card_repayments_cents": _when(F.col("kind") == "card_payment"),
        "card_purchases_cents": _when(own & (F.col("source") == card) & (F.col("amount_cents") > 0)),
        "refunds_cents": _when(own & (F.col("amount_cents") < 0), -1),
        "direct_spend_cents": _when(own & (F.col("source") == bank)),
        "transfers_cents": _when(F.col("kind") == "transfer"),
    }


def monthly(df: DataFrame, card: str, bank: str) -> DataFrame:
    """One row a month with its measures, of ledger rows or of a kept rollup's."""
    return df.groupBy("month_idx").agg(*[c.alias(n) for n, c in _measures(card, bank, "rows" in df.columns).items()]).orderBy("month_idx")


def monthly_with_maps(df: DataFrame, card: str, bank: str) -> DataFrame:
    """The same with maps of spending by category and by source category."""
    out = monthly(df, card, bank)
    for basis, name in (("category", "categories_cents"), ("source_category", "source_categories_cents")):
        by = df.filter(F.col("kind") == "spend").groupBy("month_idx", named(basis).alias("c")).agg(F.sum("amount_cents").cast("long").alias("v"))
        maps = by.groupBy("month_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "v")))).alias(name))
        out = out.join(maps, "month_idx", "left")
    return out


def map_total(c: str) -> Column:
    """The sum of a map's values."""
    return F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)


def baseline(df: DataFrame, card: str, bank: str, months: list[int]) -> DataFrame:
    """One row for the baseline months: totals, half-even average, adjustments and the episode."""
    m = _measures(card, bank)
    own = F.col("kind") == "spend"
    last = F.col("month_idx") == max(months)
    one = df.filter(F.col("month_idx").isin(months)).agg(
        m["spending_cents"].alias("spending_cents"),
        m["card_purchases_cents"].alias("card_purchases_cents"),
        m["refunds_cents"].alias("refunds_cents"),
        m["direct_spend_cents"].alias("direct_spend_cents"),
        m["debt_payments_cents"].alias("debt_excluded_cents"),
        _when(own & flag("reimbursement_candidate")).alias("reimbursement_cents"),
        _when(own & flag("nonroutine_dental_episode")).alias("episode_cents"),
        _when(own & last & flag("nonroutine_dental_episode")).alias("last_month_episode_cents"),
    )
    return one.withColumns(
        {
            "average_cents": F.bround(F.col("spending_cents") / F.lit(len(months))).cast("long"),
            "less_reimbursement_cents": F.col("spending_cents") - F.col("reimbursement_cents"),
        }
    )


def baseline_categories(df: DataFrame, months: list[int]) -> DataFrame:
    """Spending of the baseline months by category, in order of the names."""
    own = df.filter((F.col("kind") == "spend") & F.col("month_idx").isin(months))
    return own.groupBy(named("category").alias("category")).agg(F.sum("amount_cents").cast("long").alias("total_cents")).orderBy("category")


def category_in_month(df: DataFrame, category: str, month: int) -> DataFrame:
    """One row: what all records of a category, of any kind, sum to in a month."""
    return df.agg(_when((F.col("category") == category) & (F.col("month_idx") == month)).alias("category_month_cents"))


def recurring(df: DataFrame) -> DataFrame:
    """Recurring candidates as they are shown: label, basis, status in words, monthly amount as text."""
    return df.select("label", "basis", pretty(F.col("status")).alias("status"), (F.col("status") == "recurring_candidate").alias("to_review"), money(F.col("monthly_cents")).alias("monthly"))


def coverage_notes(by_source: DataFrame, labels: DataFrame, date_basis: str) -> DataFrame:
    """A line on each source: label, dates, records."""
    own = labels.select(F.col("id").alias("__of"), "label")
    whole = by_source.join(own, F.col("source") == F.col("__of"), "left")
    text = F.concat(F.date_format("start", "yyyy-MM-dd"), F.lit(" to "), F.date_format("end", "yyyy-MM-dd"), F.lit(" · "), F.format_number("rows", 0), F.lit(f" records · {date_basis}"))
    return whole.select(F.coalesce("label", "source").alias("label"), text.alias("note"))


def by_source(df: DataFrame) -> DataFrame:
    """Rows and dates of each source; the dates are those of the whole ledger."""
    whole = df.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(whole))


def audit(df: DataFrame) -> DataFrame:
    """One row: coverage of the ledger and how much its classification changed."""
    own, changed = F.col("kind") == "spend", F.coalesce("classification_changed", F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(own).alias("expense_rows"),
        F.countDistinct(F.when(own, F.col("merchant"))).alias("expense_merchants"),
        F.count_if(~own).alias("other_rows"),
        F.min("date").alias("earliest"),
        F.max("date").alias("latest"),
        F.count_if(own & changed).alias("changed_rows"),
        F.countDistinct(F.when(own & changed, F.col("merchant"))).alias("changed_merchants"),
    )


def confidence_counts(df: DataFrame) -> DataFrame:
    return df.filter(F.col("kind") == "spend").groupBy("confidence").agg(F.count(F.lit(1)).alias("rows"))


def changed_ids(df: DataFrame) -> DataFrame:
    return df.filter("classification_changed").select("id").orderBy("id")


def overview(df: DataFrame, months: list[int], category: str) -> DataFrame:
    """One row: a category's total and rows in the baseline, its part of the episode, and the average of all spending with and without that."""
    own = (F.col("kind") == "spend") & F.col("month_idx").isin(months)
    episode = (F.col("category") == category) & flag("nonroutine_dental_episode")
    one = df.filter(own).agg(
        _when(own & (F.col("category") == category)).alias("category_cents"),
        F.count_if(own & (F.col("category") == category)).alias("category_rows"),
        _when(episode).alias("episode_cents"),
        _when(own).alias("spending_cents"),
    )
    n = len(months)
    return one.withColumns({"average_cents": F.expr(js_round(f"(CAST(spending_cents AS DOUBLE) / {n})")), "average_without_cents": F.expr(js_round(f"(CAST(spending_cents - episode_cents AS DOUBLE) / {n})"))})


def observed_targets(defs: DataFrame, totals: DataFrame, months: int) -> DataFrame:
    """Target definitions with the category's observed monthly average; 0 where it has none, null without a category."""
    seen = totals.select(F.col("category").alias("cat"), "total_cents")
    average = F.expr(js_round(f"(CAST(coalesce(total_cents, 0) AS DOUBLE) / {months})"))
    return defs.join(seen, "cat", "left").select("key", "label", "cat", F.when(F.col("cat").isNotNull(), average).alias("observed_cents"))
