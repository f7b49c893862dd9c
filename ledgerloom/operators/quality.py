"""Reconciliation checks: one row each of (check, passed, observed, expected)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.predicates import flag, named


def _facts(one: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row of aggregates as a row for each check."""
    sides = [F.struct(F.lit(n).alias("check"), o.cast("long").alias("observed"), e.cast("long").alias("expected")) for n, (o, e) in tests.items()]
    return one.agg(F.array(*sides).alias("facts")).select(F.inline("facts"))


def checks(df: DataFrame, stored: DataFrame, kinds: tuple[str, ...], sources: tuple[str, ...], months: list[int], quarter: DataFrame, prefix: str = "", basis: str = "synthetic_fixture") -> DataFrame:
    """All checks of a ledger against what is stored of it.

    stored: month_idx, transaction_count, spending_cents, categories_cents (a map), covered.
    quarter: one row of the baseline `months`: spending_cents, categories_cents (a map), episode_cents.

    The ledger is read once: one aggregate counts the rows of each id and, beside them, sums up
    each month by source and kind; all checks are of these sums.
    """
    one, zero = F.lit(1), F.lit(0)
    known = F.coalesce
    own = F.col("kind") == "spend"
    some = lambda c: F.max(known(c, F.lit(False)).cast("int"))
    total = lambda c: F.sum(F.when(c, F.col("amount_cents")))
    rows = df.groupingSets([["id"], ["month_idx", "source", "kind"]], "id", "month_idx", "source", "kind").agg(
        (F.grouping("id") == 0).alias("of_id"),
        F.count(one).alias("n"),
        F.count_if(~F.startswith(known("merchant", F.lit("")), F.lit(prefix))).alias("no_prefix"),
        F.count_if(F.col("amount_cents").isNull()).alias("no_amount"),
        F.count_if(~F.col("evidence_basis").eqNullSafe(F.lit(basis))).alias("other_basis"),
        F.sum("amount_cents").alias("cents"),
        total(flag("nonroutine_dental_episode")).alias("episode"),
        some(F.col("amount_cents") < 0).alias("negative"),
        some(F.col("needs_category_review") | F.col("needs_item_review")).alias("review"),
        some(flag("reimbursement_candidate")).alias("reimbursement"),
        some(flag("business_candidate")).alias("business"),
    )
    summed = lambda c: F.sum(F.when(~F.col("of_id"), F.col(c)))
    by_month = rows.groupBy("of_id", "month_idx").agg(
        F.sum(F.when(F.col("of_id"), (F.col("n") > 1).cast("int"))).alias("repeats"),
        *[summed(c).alias(c) for c in ("n", "no_prefix", "no_amount", "other_basis", "episode")],
        known(F.sum(F.when(~F.col("of_id") & own, F.col("cents"))), zero).alias("spend"),
        F.sum(F.when(~F.col("of_id") & F.col("source").isin(*sources), F.col("n"))).alias("of_sources"),
        F.collect_set(F.when(~F.col("of_id"), F.col("source"))).alias("sources"),  # a handful
        F.collect_set(F.when(~F.col("of_id") & F.col("kind").isin(*kinds), F.col("kind"))).alias("kinds"),
        F.max(F.when(~F.col("of_id") & own, F.col("negative"))).alias("refund"),
        *[F.max(F.when(~F.col("of_id"), F.col(c))).alias(c) for c in ("review", "reimbursement", "business")],
    )
    map_sum = F.aggregate(F.map_values("categories_cents"), zero.cast("long"), lambda a, x: a + x)
    there = stored.select(F.col("month_idx").alias("__m"), "transaction_count", known("spending_cents", zero).alias("spending_cents"), "covered", known(map_sum, zero).alias("mapped"))
    both = by_month.join(there, ~F.col("of_id") & (F.col("month_idx") == F.col("__m")), "full_outer")
    month = known(~F.col("of_id"), F.lit(True))  # a ledger's month, or one that is stored alone
    differ = ~(F.col("n").eqNullSafe(F.col("transaction_count")) & F.col("spend").eqNullSafe(F.col("spending_cents")))
    recent = F.col("month_idx").isin(months) & ~F.col("of_id")
    stated = quarter.select(F.col("spending_cents").alias("__s"), map_sum.alias("__c"), F.col("episode_cents").alias("__e"))  # a row
    all_of = lambda c: known(F.sum(c), zero)
    seen = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    tests = {
        "ids_with_repeats": (all_of("repeats"), zero),
        "merchants_without_prefix": (all_of("no_prefix"), zero),
        "amounts_missing": (all_of("no_amount"), zero),
        "evidence_of_other_basis": (all_of("other_basis"), zero),
        "rows_of_known_sources": (all_of("of_sources"), all_of("n")),
        "sources_seen": (seen("sources"), F.lit(len(sources))),
        "kinds_of_ledger": (seen("kinds"), F.lit(len(kinds))),
        "has_refund": (F.max("refund"), one),
        "has_review_row": (F.max("review"), one),
        "has_reimbursement": (F.max("reimbursement"), one),
        "has_business": (F.max("business"), one),
        "baseline_spending": (known(F.sum(F.when(recent, F.col("spend"))), zero), F.max("__s")),
        "baseline_categories": (F.max("__c"), F.max("__s")),
        "baseline_episode": (known(F.sum(F.when(recent, F.col("episode"))), zero), F.max("__e")),
        "months_that_differ": (F.count_if(month & differ), zero),
        "month_maps_that_differ": (F.count_if(month & ~F.col("mapped").eqNullSafe(F.col("spending_cents"))), zero),
        "has_incomplete_month": (F.max((~F.col("covered")).cast("int")), one),
    }
    out = _facts(both.join(F.broadcast(stated), F.lit(True), "left"), tests)
    return out.select("check", F.col("observed").eqNullSafe(F.col("expected")).alias("passed"), "observed", "expected")


def category_map(df: DataFrame, keys: list[str]) -> DataFrame:
    """By the keys, the spending and a map of it by category."""
    by = df.filter(F.col("kind") == "spend").groupBy(*keys, named("category").alias("c")).agg(F.sum("amount_cents").cast("long").alias("v"))
    return by.groupBy(*keys).agg(F.sum("v").alias("spending_cents"), F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("categories_cents"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values of either side that the other lacks: (value, side)."""
    a, b = left.toDF("value"), right.toDF("value")
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))
