"""The ledger's registered queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.functions.scalars import first_day, js_round, money, month_from_index, month_index, month_label, month_text, percent_text, pretty
from ledgerloom.operators import compare, kept, quality, rollup, totals
from ledgerloom.operators.predicates import LedgerQuery, evidence_text, filtered, matches_kind, matches_review, signed_amount, status
from ledgerloom.plans import events, layers, plan, project
from ledgerloom.scenarios import FORECAST_START, PLAN_TARGETS, documents, scenarios
from ledgerloom.sources import datasets
from ledgerloom.sources.driver_tables import coverage, ledger, sources, table
from ledgerloom.sources.shared import shared_path
from ledgerloom.streaming.windows import sessions, windowed

Query = Callable[[SparkSession, str], DataFrame]
MONTH = "1998-06"
AT = month_index(MONTH)
BASELINE = [AT - 2, AT - 1, AT]
START, END = date(1998, 6, 1), date(1998, 7, 1)
CORE = ["amount_cents", "kind", "flags"]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _month(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return ledger(spark, d, columns, START, END)


def _baseline(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return ledger(spark, d, columns, first_day(BASELINE[0]), first_day(AT + 1))


@query
def totals_by_category(spark: SparkSession, d: str) -> DataFrame:
    return totals.category_totals(_month(spark, d, [*CORE, "category"]), LedgerQuery())


@query
def totals_by_source_category(spark: SparkSession, d: str) -> DataFrame:
    return totals.category_totals(ledger(spark, d, [*CORE, "source_category"]), LedgerQuery(basis="source_category"))


@query
def totals_adjusted(spark: SparkSession, d: str) -> DataFrame:
    return totals.category_totals(ledger(spark, d, [*CORE, "category"]), LedgerQuery(airfare=True, business=True))


@query
def totals_summary(spark: SparkSession, d: str) -> DataFrame:
    return totals.summary(ledger(spark, d, CORE), LedgerQuery(airfare=True, business=True))


@query
def totals_refunds(spark: SparkSession, d: str) -> DataFrame:
    return totals.category_totals(ledger(spark, d, [*CORE, "category"]), LedgerQuery(review="refund"))


@query
def search_merchant(spark: SparkSession, d: str) -> DataFrame:
    return totals.summary(ledger(spark, d, [*CORE, "merchant", "note", "category", "source_category"]), LedgerQuery(query="MACHINERY"))


@query
def search_counters(spark: SparkSession, d: str) -> DataFrame:
    columns = [*CORE, "merchant", "note", "category", "source_category", "confidence", "needs_category_review", "needs_item_review", "needs_scope_review", "classification_changed"]
    return totals.counters(ledger(spark, d, columns), LedgerQuery(query="brand#1", kind="spend"))


def _by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_cents").cast("long").alias("total_cents"))


@query
def review_unresolved(spark: SparkSession, d: str) -> DataFrame:
    columns = [*CORE, "category", "confidence", "needs_category_review", "needs_item_review", "needs_scope_review"]
    return _by_category(filtered(ledger(spark, d, columns), LedgerQuery(review="unresolved")))


@query
def review_unresolved_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _by_category(filtered(ledger(spark, d, [*CORE, "category", "confidence"]), LedgerQuery(review="unresolved")))


@query
def review_changed(spark: SparkSession, d: str) -> DataFrame:
    return _by_category(filtered(ledger(spark, d, [*CORE, "category", "classification_changed"]), LedgerQuery(review="changed")))


@query
def review_episode(spark: SparkSession, d: str) -> DataFrame:
    return _by_category(filtered(ledger(spark, d, [*CORE, "category"]), LedgerQuery(review="episode")))


@query
def review_business(spark: SparkSession, d: str) -> DataFrame:
    return _by_category(filtered(ledger(spark, d, [*CORE, "category"]), LedgerQuery(review="business")))


@query
def kind_excluded(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d, ["kind", "amount_cents"]).filter(matches_kind("excluded"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_cents").cast("long").alias("total_cents"))


PAGE_COLUMNS = ["id", "date", "merchant", "category", "kind", "amount_cents"]


def _page(rows: DataFrame, number: int) -> DataFrame:
    """A page, latest first; it is looked up by dates, then by ever longer beginnings of ids."""
    order = [F.col("date").desc(), *map(F.col, ("id", "merchant", "category", "kind", "amount_cents"))]
    parts = [(F.col("date"), True), *[(F.substring("id", 1, n), False) for n in (2, 4, 6, 8)]]
    return totals.page(rows, order, number, parts=parts)


@query
def ledger_page(spark: SparkSession, d: str) -> DataFrame:
    return _page(_month(spark, d, PAGE_COLUMNS), 3)


@query
def ledger_last_page(spark: SparkSession, d: str) -> DataFrame:
    """The last page of all rows."""
    return _page(ledger(spark, d, PAGE_COLUMNS), 10**9)


@query
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger(spark, d, [*CORE, "needs_category_review", "needs_item_review", "needs_scope_review"])
    return rows.groupBy(status(rows, LedgerQuery(airfare=True)).alias("status")).agg(F.count(F.lit(1)).alias("rows"))


@query
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _month(spark, d, ["kind", "direction", "amount_cents", "note", "source", "date"]).withColumn("evidence_summary", F.lit(None).cast("string"))
    labels = sources(spark).select(F.col("id").alias("of"), "label")
    rows = rows.join(F.broadcast(labels), F.col("source") == F.col("of"), "left")
    shown = rows.select(pretty(F.col("kind")).alias("kind"), F.coalesce("label", "source").alias("source"), evidence_text("No evidence").alias("evidence"), month_label(F.col("date")).alias("month"), signed_amount().alias("shown"))
    return shown.groupBy("kind", "source", "evidence", "month").agg(F.count(F.lit(1)).alias("rows"), F.sum("shown").cast("long").alias("shown_cents"), money(F.sum("shown").cast("long")).alias("shown_text"))


@query
def kind_sums(spark: SparkSession, d: str) -> DataFrame:
    return totals.kind_sums(_baseline(spark, d, ["kind", "amount_cents"]), ["card_payment", "transfer", "investment", "debt_payment"])


@query
def flag_sums(spark: SparkSession, d: str) -> DataFrame:
    return totals.flag_sums(_baseline(spark, d, CORE), ["reimbursement_candidate", "business_candidate", "nonroutine_dental_episode"])


@query
def adjustment_potentials(spark: SparkSession, d: str) -> DataFrame:
    return totals.flag_sums(_month(spark, d, CORE), ["reimbursement_candidate", "business_candidate"])


@query
def payroll_summary(spark: SparkSession, d: str) -> DataFrame:
    return totals.payroll(_baseline(spark, d, ["kind", "amount_cents", "income_type"]), 3)


@query
def merchant_groups(spark: SparkSession, d: str) -> DataFrame:
    columns = [*CORE, "category", "merchant", "confidence", "needs_category_review", "needs_item_review", "needs_scope_review"]
    return totals.merchant_groups(ledger(spark, d, columns))


@query
def category_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return totals.grouping_sets(ledger(spark, d, ["amount_cents", "kind", "category", "merchant"]))


@query
def month_drill(spark: SparkSession, d: str) -> DataFrame:
    return totals.month_drill(ledger(spark, d, [*CORE, "month_idx"]), LedgerQuery(business=True))


@query
def top_n_other(spark: SparkSession, d: str) -> DataFrame:
    return totals.top_and_other(totals.category_totals(ledger(spark, d, [*CORE, "source_category"]), LedgerQuery(basis="source_category")), 6)


@query
def share_of_max(spark: SparkSession, d: str) -> DataFrame:
    return totals.share_of_largest(totals.category_totals(ledger(spark, d, [*CORE, "source_category"]), LedgerQuery(basis="source_category")).select("category", "total_cents"))


@query
def trend_heights(spark: SparkSession, d: str) -> DataFrame:
    by_month = totals.month_drill(ledger(spark, d, [*CORE, "month_idx"]), LedgerQuery()).select(F.col("month_idx").cast("string").alias("category"), "total_cents")
    return totals.share_of_largest(by_month)


@query
def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.monthly(ledger(spark, d, ["month_idx", "kind", "amount_cents", "source"]), "F", "O")


@query
def monthly_map_totals(spark: SparkSession, d: str) -> DataFrame:
    whole = rollup.monthly_with_maps(ledger(spark, d, ["month_idx", "kind", "amount_cents", "source", "category", "source_category"]), "F", "O")
    return whole.select("month_idx", "spending_cents", rollup.map_total("categories_cents").alias("categories_cents"), F.size("categories_cents").alias("categories"), rollup.map_total("source_categories_cents").alias("source_categories_cents"))


@query
def quarter_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.baseline(_baseline(spark, d, [*CORE, "month_idx", "source"]), "F", "O", BASELINE)


@query
def overview(spark: SparkSession, d: str) -> DataFrame:
    return rollup.overview(_baseline(spark, d, [*CORE, "month_idx", "category"]), BASELINE, "ECONOMY")


@query
def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.by_source(ledger(spark, d, ["source", "date"]))


@query
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.audit(ledger(spark, d, ["kind", "merchant", "date", "classification_changed"]))


@query
def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.confidence_counts(ledger(spark, d, ["kind", "confidence"]))


@query
def changed_row_ids(spark: SparkSession, d: str) -> DataFrame:
    return rollup.changed_ids(ledger(spark, d, ["id", "classification_changed"]))


@query
def ytd_vs_prior(spark: SparkSession, d: str) -> DataFrame:
    return totals.prior_year(ledger(spark, d, ["kind", "amount_cents", "month_idx"], "1997-01-01", END), 1998, 6)


def _compare(lookback: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        _, start, end = compare.bounds(MONTH, lookback)
        return compare.compare_month(ledger(spark, d, [*CORE, "category", "month_idx"], start, end), coverage(spark, d, start, end), MONTH, lookback)

    return run


QUERIES |= {f"compare_{n}m": _compare(n) for n in compare.LOOKBACKS}


@query
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    _, start, end = compare.bounds(MONTH, 12)
    return compare.compare_summary(ledger(spark, d, [*CORE, "category", "month_idx"], start, end), coverage(spark, d, start, end), MONTH, 12, LedgerQuery(airfare=True))


@query
def compare_targets(spark: SparkSession, d: str) -> DataFrame:
    """The month against its usual with targets, of which two categories share one."""
    _, start, end = compare.bounds(MONTH, 3)
    rows = ledger(spark, d, [*CORE, "category", "month_idx"], start, end)
    targets = spark.createDataFrame([("ECONOMY", 250_000), ("STANDARD", None), ("PROMO", 100)], "cat string, target_cents long")
    compared = compare.compare_month(rows, coverage(spark, d, start, end), MONTH, 3).select("category", "actual_cents", "average_cents", "signal")
    return compare.with_targets(compared, targets, rows, MONTH, combined=True, shared=("PROMO", "SMALL"), episode="ECONOMY")


@query
def usual_all_months(spark: SparkSession, d: str) -> DataFrame:
    return compare.usual_by_month(ledger(spark, d, ["kind", "amount_cents", "category", "month_idx"]), coverage(spark, d), 12)


@query
def incomplete_coverage_badge(spark: SparkSession, d: str) -> DataFrame:
    return compare.incomplete_months(coverage(spark, d, first_day(AT - 11), first_day(AT + 1)), AT - 11, AT)


@query
def coverage_calendar(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d).withColumn("month", F.expr(month_text("month_idx")))


@query
def target_join(spark: SparkSession, d: str) -> DataFrame:
    names = ["ECONOMY", "STANDARD", "PROMO", "MISSING"]
    defs = spark.createDataFrame([(n.lower(), n.title(), n) for n in names] + [("none", "None", None)], "key string, label string, cat string")
    own = totals.category_totals(_baseline(spark, d, [*CORE, "category"]), LedgerQuery())
    return rollup.observed_targets(defs, own, len(BASELINE))


@query
def unresolved_merchants(spark: SparkSession, d: str) -> DataFrame:
    return totals.unresolved_merchants(ledger(spark, d, ["kind", "amount_cents", "merchant", "needs_category_review"]))


@query
def category_list(spark: SparkSession, d: str) -> DataFrame:
    return totals.category_list(ledger(spark, d, ["kind", "source_category"]), "source_category")


@query
def category_set_difference(spark: SparkSession, d: str) -> DataFrame:
    one = lambda q: filtered(ledger(spark, d, [*CORE, "merchant", "date"]), q).select("merchant")
    return quality.set_difference(one(LedgerQuery(start=START, end=date(1998, 6, 30))), one(LedgerQuery(review="refund", start=date(1998, 5, 1), end=date(1998, 5, 31))))


@query
def review_modes(spark: SparkSession, d: str) -> DataFrame:
    columns = [*CORE, "category", "confidence", "needs_category_review", "needs_item_review", "needs_scope_review", "classification_changed"]
    rows = ledger(spark, d, columns)
    return rows.agg(*[F.count_if(matches_review(rows, m)).alias(m) for m in ("dental", "episode", "unresolved", "changed", "business", "refund", "all")])


def _plans(spark: SparkSession, d: str, mode: str) -> DataFrame:
    out = plan.evaluate(scenarios(spark, d), PLAN_TARGETS).filter(F.col("plan_mode") == mode)
    cents = ["income", "person_a_income", "person_b_income", "expense", "personal_debt", "allocation", "allowance", "allocation_deficit", "baby", "savings", "reduction", "current_room", "future_room"]
    return out.select("scenario_id", *cents, F.size("missing").alias("missing_count"), F.array_join("incomplete", "|").alias("incomplete"))


@query
def plan_household(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d, "household")


@query
def plan_joint(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d, "joint")


@query
def months_to_goal(spark: SparkSession, d: str) -> DataFrame:
    return plan.evaluate(scenarios(spark, d), PLAN_TARGETS).select("scenario_id", "months_to_goal")


@query
def plan_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return plan.breakdown(plan.evaluate(scenarios(spark, d), PLAN_TARGETS))


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return project.project(scenarios(spark, d), PLAN_TARGETS)


@query
def project_cash(spark: SparkSession, d: str) -> DataFrame:
    return project.rows(_projected(spark, d))


@query
def project_no_yield_window(spark: SparkSession, d: str) -> DataFrame:
    """Balances of scenarios without yield, as a running sum over the projected months."""
    from pyspark.sql import Window

    plain = _projected(spark, d).filter("forecast.cash_yield = 0")
    rows = plain.select("scenario_id", "current_cash_cents", "start_idx", F.posexplode_outer("nets").alias("i", "net")).withColumn("month", F.expr(month_text("(start_idx + i)")))
    running = Window.partitionBy("scenario_id").orderBy("i")
    known = F.min(F.col("net").isNotNull()).over(running)
    return rows.select("scenario_id", "month", F.when(known, F.col("current_cash_cents") + F.sum("net").over(running)).cast("long").alias("cash"))


@query
def project_events(spark: SparkSession, d: str) -> DataFrame:
    """Debts that end, one-off costs and leaves of every projected month, by an interval join."""
    return events.projected_events(scenarios(spark, d), PLAN_TARGETS)


@query
def project_milestones(spark: SparkSession, d: str) -> DataFrame:
    return project.milestones(_projected(spark, d))


@query
def project_missing(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).select("scenario_id", F.array_join("projection_missing", "|").alias("missing"))


@query
def merged_states(spark: SparkSession, d: str) -> DataFrame:
    """What the layers of every scenario's documents make of the default state."""
    embedded, saved = documents(spark, d)
    merged = layers.merge_layers(layers.default_states(spark, embedded, FORECAST_START), embedded, saved)
    once = F.transform("forecast.oneoffs", lambda o: F.concat_ws(":", o["label"], F.coalesce(o["amount"].cast("long").cast("string"), F.lit("unknown")), o["month"]))
    return merged.select(
        "scenario_id", "person_a_pay", "other_income", "health_mode", "tab", "health_notice", "audit_notice", "adjustments.airfare", F.col("checks")["income"].alias("income_checked"),
        *[F.try_element_at("targets", F.lit(k)).alias(f"target_{k}") for k in ("dining", "medical", "dental", "student")], F.map_contains_key("targets", "vision").alias("has_vision"),
        F.col("forecast.months").alias("months"), F.col("forecast.cash_yield").alias("cash_yield"), F.col("forecast.baby_start").alias("baby_start"),
        F.array_join(once, "|").alias("oneoffs"), F.col("forecast.debt_ends")["student"].alias("student_ends"), F.size("forecast.debt_ends").alias("debt_ends"),
    )


KEPT_COLUMNS = [*CORE, "month_idx", "source", "category", "source_category"]


def _kept(spark: SparkSession, d: str, cuts: tuple[date, ...] = (START, date(1998, 6, 16))) -> DataFrame:
    """The kept rollup of the ledger, which arrives in parts cut at some days."""
    path = shared_path(spark, "rollup")
    for start, end in zip((None, *cuts), (*cuts, None), strict=True):
        kept.append(ledger(spark, d, KEPT_COLUMNS, start, end), path)
    return kept.read(spark, path)


@query
def kept_monthly(spark: SparkSession, d: str) -> DataFrame:
    whole = rollup.monthly_with_maps(_kept(spark, d), "F", "O")
    return whole.drop("categories_cents", "source_categories_cents").join(whole.select("month_idx", rollup.map_total("categories_cents").alias("categories_cents")), "month_idx")


@query
def kept_compare(spark: SparkSession, d: str) -> DataFrame:
    """The month against its usual, of partial sums instead of rows."""
    rows = _kept(spark, d)
    months = rows.select("month_idx").distinct().withColumn("covered", F.col("month_idx") % 7 != 0)
    return compare.compare_month(rows, months, MONTH, 12)


@query
def merchants_by_year(spark: SparkSession, d: str) -> DataFrame:
    pairs = kept.merchant_months(ledger(spark, d, ["kind", "month_idx", "merchant", "classification_changed"]))
    return kept.distinct_merchants(pairs, F.floor(F.col("month_idx") / 12).cast("int"))


@query
def dq_checks(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's rows against its kept rollup."""
    rows = ledger(spark, d, [*CORE, "id", "merchant", "source", "category", "month_idx", "needs_category_review", "needs_item_review", "evidence_basis"])
    held = _kept(spark, d, ())
    counted = held.groupBy("month_idx").agg(F.sum("rows").alias("transaction_count"))
    stored = counted.join(quality.category_map(held, ["month_idx"]), "month_idx", "left").withColumn("covered", F.col("month_idx") % 7 != 0)
    recent = held.filter(F.col("month_idx").isin(BASELINE))
    episode = recent.agg(F.coalesce(F.sum(F.when(F.array_contains("flags", "nonroutine_dental_episode"), F.col("amount_cents"))), F.lit(0)).alias("episode_cents"))
    quarter = quality.category_map(recent, []).crossJoin(episode)  # a row each
    return quality.checks(rows, stored, ("spend", "income", "card_payment"), ("O", "F"), BASELINE, quarter, "Supplier")


@query
def drill_rows(spark: SparkSession, d: str) -> DataFrame:
    columns = [*CORE, "category", "merchant", "date", "id", "note", "confidence"]
    return totals.drill_rows(_baseline(spark, d, columns).withColumn("evidence_summary", F.lit(None).cast("string")))


@query
def baseline_categories(spark: SparkSession, d: str) -> DataFrame:
    return rollup.baseline_categories(_baseline(spark, d, ["kind", "amount_cents", "category", "month_idx"]), BASELINE)


@query
def category_in_month(spark: SparkSession, d: str) -> DataFrame:
    return rollup.category_in_month(_month(spark, d, ["amount_cents", "category", "month_idx"]), "ECONOMY", AT)


@query
def recurring_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A part's retail price as a repeated payment."""
    status = F.when(F.col("p_size") % 2 == 0, "recurring_candidate").otherwise("synthetic")
    rows = table(spark, d, "part").select(F.col("p_name").alias("label"), F.col("p_brand").alias("basis"), status.alias("status"), F.expr(js_round("(p_retailprice * 100)")).alias("monthly_cents"))
    return rollup.recurring(rows)


@query
def coverage_notes(spark: SparkSession, d: str) -> DataFrame:
    return rollup.coverage_notes(rollup.by_source(ledger(spark, d, ["source", "date"])), sources(spark), "Posted dates")


@query
def plan_warnings(spark: SparkSession, d: str) -> DataFrame:
    return plan.warnings(plan.evaluate(scenarios(spark, d), PLAN_TARGETS))


@query
def goal_status(spark: SparkSession, d: str) -> DataFrame:
    return plan.goal_status(plan.evaluate(scenarios(spark, d), PLAN_TARGETS))


@query
def visible_targets(spark: SparkSession, d: str) -> DataFrame:
    return plan.visible_targets(plan.evaluate(scenarios(spark, d), PLAN_TARGETS), PLAN_TARGETS)


@query
def flexible_total(spark: SparkSession, d: str) -> DataFrame:
    return session.flexible(plan.evaluate(scenarios(spark, d), PLAN_TARGETS))


@query
def projected_bounds(spark: SparkSession, d: str) -> DataFrame:
    return session.chart_bounds(_projected(spark, d))


@query
def percent_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every category's share of the month's spending, and its change on the month before, as text."""
    rows = ledger(spark, d, ["kind", "amount_cents", "category", "month_idx"], first_day(AT - 1), END)
    own = rows.filter("kind = 'spend'").groupBy("category").agg(*[F.coalesce(F.sum(F.when(F.col("month_idx") == m, F.col("amount_cents"))), F.lit(0)).alias(n) for n, m in (("now", AT), ("prior", AT - 1))])
    change = F.when(F.col("prior") > 0, (F.col("now") / F.col("prior") - 1) * 100)
    return own.select("category", percent_text(change, 0).alias("change"), percent_text(change).alias("change_exact"))


@query
def events_by_day(spark: SparkSession, d: str) -> DataFrame:
    return windowed(table(spark, d, "events"))


@query
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "6 hours")


@query
def money_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = totals.category_totals(_month(spark, d, [*CORE, "category"]), LedgerQuery())
    average = F.expr(js_round("(CAST(total_cents AS DOUBLE) / rows)"))
    return rows.select("category", money(F.col("total_cents")).alias("total"), money(average, 0).alias("average"), F.lit(month_from_index(AT)).alias("month"))


@query
def document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The whole ledger written as a JSON document and read from its fragments: categories by month and kind."""
    own = ["id", "date", "merchant", "amount_cents", "category", "kind", "source", "flags"]
    rows = ledger(spark, d, own).withColumnsRenamed({"amount_cents": "amountCents"})
    months = coverage(spark, d).select(F.expr(month_text("month_idx")).alias("month"), F.col("covered").alias("hasMainCardCoverage"))
    empty = spark.createDataFrame([], "label string")
    path = shared_path(spark, "document")
    datasets.write_document({"transactions": rows, "sources": sources(spark), "monthly": months, **{k: empty for k in ("quarter", "defaultPeriod", "recurring")}}, path, "gzip")
    read = datasets.read_json(spark, path, ["month_idx", "category", "kind", "amount_cents", "merchant", "flags"])
    covered = read["monthly"].select(F.col("month_idx").alias("month"), "covered")
    sums = read["ledger"].groupBy("month_idx", "category", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_cents").alias("total_cents"), F.count_distinct("merchant").alias("merchants"), F.sum(F.size("flags")).alias("flags"))
    return sums.join(covered, F.col("month_idx") == F.col("month")).drop("month")
