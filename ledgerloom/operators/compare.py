"""A month against the usual: trailing averages over the covered months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import first_day, js_round, money, month_index
from ledgerloom.operators.predicates import LedgerQuery, filtered, flag, named, removed

LOOKBACKS = (3, 6, 12)
#: Categories whose high months are seasonal; fixed values.
SEASONAL = ("Electricity", "Natural gas", "Electric", "Gas & Fuel")


def bounds(selected: str, lookback: int) -> tuple[int, str, str]:
    """The month's index, and the first day of the window and the one after the month."""
    at = month_index(selected)
    if at is None or lookback not in LOOKBACKS:
        raise ValueError("choose a month and 3, 6 or 12 months before it")
    return at, first_day(at - lookback), first_day(at + 1)


def covered_months(coverage: DataFrame, at: int, lookback: int) -> list[int]:
    """The covered months before `at`, as many as the lookback at most."""
    own = coverage.filter(F.col("covered") & (F.col("month_idx") < at) & (F.col("month_idx") >= at - lookback))
    return sorted(r.month_idx for r in own.select("month_idx").distinct().collect())


#: The signal of a compared category; the conditions hold in this order.
SIGNAL = """CASE WHEN average_cents IS NULL THEN 'No baseline'
 WHEN average_cents = 0 THEN CASE WHEN actual_cents > 0 THEN 'New in this window' WHEN actual_cents < 0 THEN 'Refund / credit' ELSE 'No spending' END
 WHEN average_cents < 0 THEN 'Refund-heavy baseline'
 WHEN difference_cents > greatest(CAST(10000 AS DOUBLE), average_cents * CAST(0.25 AS DOUBLE)) THEN CASE WHEN category IN ('Electricity', 'Natural gas', 'Electric', 'Gas & Fuel') THEN 'Seasonal comparison' ELSE 'Higher than usual' END
 WHEN difference_cents < -greatest(CAST(10000 AS DOUBLE), average_cents * CAST(0.25 AS DOUBLE)) THEN 'Lower than usual'
 ELSE 'Within comparison band' END"""


def _sums(df: DataFrame, at: int, months: list[int], lookback: int, q: LedgerQuery) -> tuple[DataFrame, list]:
    """The window's spending rows, and sums of the month and of its covered baseline."""
    rows = filtered(df, LedgerQuery(category=q.category, basis=q.basis, query=q.query, review=q.review))
    rows = rows.filter((F.col("month_idx") >= at - lookback) & (F.col("month_idx") <= at) & (F.col("kind") == "spend") & ~removed(q))
    base = F.col("month_idx").isin(months) if months else F.lit(False)
    rows = rows.filter((F.col("month_idx") == at) | base)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_cents"))), F.lit(0)).cast("long")
    return rows, [total(F.col("month_idx") == at).alias("actual_cents"), total(base).alias("base_cents")]


def compare_month(df: DataFrame, coverage: DataFrame, selected: str, lookback: int = 3, q: LedgerQuery | None = None) -> DataFrame:
    """By category: actual, usual (null without covered months), difference, percent in basis points, signal.

    One scan of the month and its window gives both sums; the divisor is the number of
    covered months, whether or not the category has rows in them.
    """
    q, (at, _, _) = q or LedgerQuery(), bounds(selected, lookback)
    months = covered_months(coverage, at, lookback)
    rows, sums = _sums(df, at, months, lookback, q)
    out = rows.groupBy(named(q.basis).alias("category")).agg(*sums)
    average = F.expr(js_round(f"(CAST(base_cents AS DOUBLE) / {len(months)})")) if months else F.lit(None).cast("long")
    out = out.withColumn("average_cents", average).withColumn("difference_cents", F.col("actual_cents") - F.col("average_cents"))
    percent = F.when(F.col("average_cents") > 0, F.expr(js_round("(CAST(difference_cents AS DOUBLE) / average_cents * 10000)")))
    out = out.withColumns({"percent_bp": percent, "signal": F.expr(SIGNAL), "seasonal": F.col("category").isin(*SEASONAL)})
    return out.select("category", "actual_cents", "average_cents", "difference_cents", "percent_bp", "signal", "seasonal").orderBy(F.col("actual_cents").desc(), "category")


def compare_summary(df: DataFrame, coverage: DataFrame, selected: str, lookback: int = 3, q: LedgerQuery | None = None) -> DataFrame:
    """One row: covered months, whether the month is covered, actual and usual in all."""
    q, (at, _, _) = q or LedgerQuery(), bounds(selected, lookback)
    months = covered_months(coverage, at, lookback)
    rows, sums = _sums(df, at, months, lookback, q)
    one = rows.agg(*sums)
    average = F.expr(js_round(f"(CAST(base_cents AS DOUBLE) / {len(months)})")) if months else F.lit(None).cast("long")
    covered = coverage.filter((F.col("month_idx") == at) & F.col("covered")).limit(1).count() > 0
    return one.select(F.lit(at).alias("month_idx"), F.lit(len(months)).alias("coverage_count"), F.lit(covered).alias("selected_covered"), "actual_cents", average.alias("average_cents"))


#: Categories that share one target where a health plan is combined; fixed values.
SHARED_HEALTH = ("Medical & pharmacy", "Dental")


def with_targets(compared: DataFrame, targets: DataFrame, df: DataFrame, selected: str, basis: str = "category", combined: bool = False, shared: tuple[str, ...] = SHARED_HEALTH, episode: str = "Dental") -> DataFrame:
    """Compared categories with the text of their target, and whether their month has the nonroutine episode.

    targets: (cat, target_cents), one row for each category. A category without a target, and every one on
    another basis, has a dash. df: the month's ledger rows.
    """
    at = month_index(selected)
    month = df.filter(F.col("month_idx") == at).agg(F.coalesce(F.max(flag("nonroutine_dental_episode")), F.lit(False)).alias("__episode"))
    own = targets.select(F.col("cat").alias("__cat"), F.col("target_cents").alias("__cents"), F.lit(True).alias("__has"))
    match = (F.col("category") == F.col("__cat")) & F.lit(basis == "category")
    joined = compared.join(own, match, "left").crossJoin(month)  # a row of the month
    text = F.when(F.lit(combined) & F.col("category").isin(*shared), "Shared health target").when(F.col("__has"), money(F.col("__cents"))).otherwise("—")
    return joined.select(*compared.columns, text.alias("target"), ((F.col("category") == episode) & F.col("__episode")).alias("episode"))


def usual_by_month(df: DataFrame, coverage: DataFrame, lookback: int = 12, basis: str = "category") -> DataFrame:
    """Every covered or uncovered month of every category against the covered months before it.

    The ledger is reduced to one row for each category and month first; the grid, the
    windows and the divisor work on that small table. A frame over month numbers, not
    rows, leaves gaps out.
    """
    rows = df.filter(F.col("kind") == "spend")
    by_month = rows.groupBy(named(basis).alias("category"), "month_idx").agg(F.sum("amount_cents").cast("long").alias("cents"))
    frame = lambda w: w.orderBy("month_idx").rangeBetween(-lookback, -1)
    months = coverage.select("month_idx", "covered")
    # one row for each month
    months = months.withColumn("months", F.coalesce(F.sum(F.col("covered").cast("int")).over(frame(Window.partitionBy(F.lit(0)))), F.lit(0)).cast("long"))
    grid = by_month.select("category").distinct().crossJoin(F.broadcast(months))
    full = grid.join(by_month, ["category", "month_idx"], "left").withColumn("cents", F.coalesce("cents", F.lit(0)))
    base = F.sum(F.when(F.col("covered"), F.col("cents"))).over(frame(Window.partitionBy("category")))
    full = full.withColumn("base_cents", F.coalesce(base, F.lit(0)).cast("long"))
    average = F.when(F.col("months") > 0, F.expr(js_round("(CAST(base_cents AS DOUBLE) / CASE WHEN months > 0 THEN months END)")))
    return full.select("category", "month_idx", F.col("cents").alias("actual_cents"), "months", average.alias("average_cents"))


def incomplete_months(coverage: DataFrame, start: int, end: int) -> DataFrame:
    """One row: how many months of a period have rows but no coverage, and whether any has."""
    own = coverage.filter((F.col("month_idx") >= start) & (F.col("month_idx") <= end))
    return own.agg(F.count_if(~F.col("covered")).alias("incomplete_months"), F.coalesce(F.max(~F.col("covered")), F.lit(False)).alias("incomplete"))
