"""The made-up ledger's known totals, and the rules of totals and comparison on small rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import compare, kept, quality, ranges, rollup, totals
from ledgerloom.operators.predicates import LedgerQuery, evidence_text, filtered, matches_review, signed_amount, status
from ledgerloom.sources import sample

ROW = "id string, kind string, date date, amount_cents long, category string, source_category string, merchant string, flags array<string>, note string"


def small(spark, *rows):
    """Rows of (month, dollars) and what differs from a Food purchase."""
    out = []
    for k, (month, dollars, *more) in enumerate(rows):
        own = {"kind": "spend", "category": "Food", "merchant": "Sample Shop", "flags": [], "note": ""} | (more[0] if more else {})
        y, m = map(int, month.split("-"))
        out.append((str(k), own["kind"], date(y, m, 5), round(dollars * 100), own["category"], own["category"], own["merchant"], own["flags"], own["note"]))
    return spark.createDataFrame(out, ROW).withColumn("month_idx", F.year("date") * 12 + F.month("date") - 1)


def covered(spark, *months):
    rows = [(int(m[:4]) * 12 + int(m[5:7]) - 1, not m.endswith("!")) for m in months]
    return spark.createDataFrame(rows, "month_idx int, covered boolean")


SUMMER = ("2031-06", "2031-07", "2031-08", "2031-09")


@pytest.fixture(scope="module")
def ledger(spark):
    return sample.ledger(spark).cache()


def test_sample_ledger(spark, ledger):
    assert ledger.count() == 576 and ledger.filter("kind = 'spend'").count() == 456
    by_month = {r.month_idx: r.total_cents for r in totals.month_drill(ledger, LedgerQuery()).collect()}
    want = {sample.FIRST_MONTH + i: (260800, 262500, 264200)[i % 3] for i in range(24)}
    want |= {2031 * 12 + 7: 281500, 2031 * 12 + 8: 306100}
    assert by_month == want
    assert totals.summary(ledger, LedgerQuery()).first().spending_cents == 6_360_900
    r = totals.prior_year(ledger, 2031, 9).first()
    assert (r.now_cents, r.prior_cents) == (2_423_400, 2_362_500)


def test_sample_baseline(ledger):
    q = LedgerQuery(start="2031-07-01", end="2031-09-30")
    got = {r.category: r.total_cents for r in totals.category_totals(ledger, q).collect()}
    assert got == {
        "Mortgage": 330000, "Groceries & meal kits": 144000, "Dining & drinks": 54000, "Dental": 50900, "Shopping & mixed retail": 43500, "Fuel & charging": 36000, "Travel & parking": 34000,
        "Electricity": 30000, "Home & hardware": 24000, "Pets": 19500, "Natural gas": 18000, "Vehicle care & registration": 13500, "Entertainment": 12000, "Municipal payments": 10500,
        "Apps & subscriptions": 10500, "Medical & pharmacy": 7500, "Uncategorized / review": 6000, "Vision": 4500,
    }
    one = rollup.baseline(ledger, "sample-card", "sample-bank", [2031 * 12 + m for m in (6, 7, 8)]).first()
    assert one.spending_cents == 848_400 and one.average_cents == 282_800 and one.last_month_episode_cents == 45000 and one.reimbursement_cents == 24000


def test_sample_comparison(spark, ledger):
    got = {r.category: r for r in compare.compare_month(ledger, sample.months(spark), "2031-09", 3).collect()}
    d, t = got["Dental"], got["Travel & parking"]
    assert (d.actual_cents, d.average_cents, d.difference_cents, d.percent_bp, d.signal) == (45000, 3000, 42000, 140000, "Higher than usual")
    assert (t.actual_cents, t.average_cents, t.difference_cents, t.signal) == (5100, 11333, -6233, "Within comparison band")
    assert {r.signal for c, r in got.items() if c != "Dental"} == {"Within comparison band"}


def test_adjustments_and_their_identity(ledger):
    r = totals.summary(ledger, LedgerQuery(airfare=True, business=True)).first()
    assert r.adjustment_cents > 0 and r.spending_cents - r.adjustment_cents == r.adjusted_cents
    by = totals.category_totals(ledger, LedgerQuery(airfare=True, business=True)).agg(F.sum("total_cents")).first()[0]
    assert by == r.adjusted_cents


def test_checks_of_the_sample(spark, ledger):
    ledger = ledger.withColumn("evidence_basis", F.lit("synthetic_fixture"))
    counted = ledger.groupBy("month_idx").agg(F.count(F.lit(1)).alias("transaction_count"))
    stored = counted.join(quality.category_map(ledger, ["month_idx"]), "month_idx").withColumn("covered", F.col("month_idx") != sample.FIRST_MONTH)
    last = sorted(r.month_idx for r in counted.collect())[-3:]
    recent = ledger.filter(F.col("month_idx").isin(last))
    flagged = F.when(F.array_contains("flags", "nonroutine_dental_episode"), F.col("amount_cents"))
    quarter = quality.category_map(recent, []).crossJoin(recent.agg(F.coalesce(F.sum(flagged), F.lit(0)).alias("episode_cents")))
    kinds = ("spend", "income", "card_payment", "transfer", "investment", "debt_payment")

    def failed(df=ledger, stored=stored, quarter=quarter, sources=("sample-bank", "sample-card"), prefix="Sample"):
        return {r.check for r in quality.checks(df, stored, kinds, sources, last, quarter, prefix).filter("NOT passed").collect()}

    assert failed() == set() and quality.checks(ledger, stored, kinds, ("sample-bank", "sample-card"), last, quarter, "Sample").count() == 17
    first = F.col("month_idx") == sample.FIRST_MONTH
    broken = stored.withColumn("spending_cents", F.col("spending_cents") + first.cast("int"))
    assert failed(stored=broken, sources=("sample-bank",), prefix="Simple") == {"months_that_differ", "month_maps_that_differ", "rows_of_known_sources", "sources_seen", "merchants_without_prefix"}
    assert failed(stored=stored.withColumn("covered", F.lit(True))) == {"has_incomplete_month"}
    assert failed(quarter=quarter.withColumns({"spending_cents": F.col("spending_cents") + 1, "episode_cents": F.lit(-5)})) == {"baseline_spending", "baseline_categories", "baseline_episode"}
    other = ledger.withColumn("evidence_basis", F.when(F.col("amount_cents") > 0, "synthetic_fixture"))
    assert failed(df=other.withColumn("id", F.lit("same"))) == {"evidence_of_other_basis", "ids_with_repeats"}


def test_refunds_count_and_repayments_do_not(spark):
    df = small(spark, ("2031-09", 100), ("2031-09", -25), ("2031-09", 75, {"kind": "card_payment"}))
    r = totals.summary(df, LedgerQuery()).first()
    assert (r.rows, r.spending_cents) == (3, 7500)


@pytest.mark.parametrize(
    ("rows", "months", "average", "percent", "signal"),
    [
        ([("2031-06", 100), ("2031-07", 200), ("2031-08", 300), ("2031-09", 800)], SUMMER, 20000, 30000, "Higher than usual"),
        ([("2031-06", 300), ("2031-09", 100)], SUMMER, 10000, 0, "Within comparison band"),
        ([("2031-06", 300), ("2031-07", 900), ("2031-08", 300), ("2031-09", 100)], ("2031-06", "2031-07!", "2031-08", "2031-09"), 30000, -6667, "Lower than usual"),
        ([("2031-08", 300), ("2031-09", 100)], ("2031-08!", "2031-09"), None, None, "No baseline"),
        ([("2031-09", 100)], SUMMER, 0, None, "New in this window"),
        ([("2031-09", -100)], SUMMER, 0, None, "Refund / credit"),
        ([("2031-08", 5), ("2031-07", -5), ("2031-09", 1), ("2031-09", -1)], SUMMER, 0, None, "No spending"),
        ([("2031-08", -300), ("2031-09", 100)], SUMMER, -10000, None, "Refund-heavy baseline"),
        ([("2031-08", 300, {"category": "Electricity"}), ("2031-09", 400, {"category": "Electricity"})], SUMMER, 10000, 30000, "Seasonal comparison"),
        ([("2031-08", 300), ("2031-09", 180)], SUMMER, 10000, 8000, "Within comparison band"),
    ],
)
def test_comparison(spark, rows, months, average, percent, signal):
    (r,) = compare.compare_month(small(spark, *rows), covered(spark, *months), "2031-09", 3).collect()
    assert (r.average_cents, r.percent_bp, r.signal) == (average, percent, signal)


def test_comparison_takes_the_filters_on_both_sides(spark):
    df = small(spark, ("2031-08", 300), ("2031-08", 900, {"category": "Pets"}), ("2031-08", 90, {"merchant": "Other"}), ("2031-09", 400), ("2031-09", 7, {"merchant": "Other"}))
    (r,) = compare.compare_month(df, covered(spark, *SUMMER), "2031-09", 3, LedgerQuery(category="Food", query="sample shop")).collect()
    assert (r.category, r.actual_cents, r.average_cents) == ("Food", 40000, 10000)
    one = compare.compare_summary(df, covered(spark, *SUMMER), "2031-09", 3).first()
    assert (one.coverage_count, one.selected_covered, one.actual_cents, one.average_cents) == (3, True, 40700, 43000)


def test_comparison_ignores_the_selected_month_in_its_baseline(spark):
    months = covered(spark, *SUMMER)
    a, b = ({r.category: r.average_cents for r in compare.compare_month(small(spark, ("2031-08", 60), ("2031-09", x)), months, "2031-09", 6).collect()} for x in (1, 5000))
    assert a == b == {"Food": 2000}  # three of the six months are in the calendar
    for month, lookback in (("2031-13", 3), ("2031-09", 4)):
        with pytest.raises(ValueError):
            compare.bounds(month, lookback)


def test_reviews_names_and_status(spark):
    df = small(
        spark, ("2031-09", 1, {"flags": ["Mixed_Retail"]}), ("2031-09", 2, {"category": "Dental", "flags": ["nonroutine_dental_episode"]}), ("2031-09", -3, {"flags": ["classification_audit_changed"]}),
        ("2031-09", 4, {"category": None, "flags": ["business_candidate"]}), ("2031-09", 5, {"category": "", "flags": None, "note": "Fine <print>"}),
    )
    count = lambda mode: df.filter(matches_review(df, mode)).count()
    assert [count(m) for m in ("dental", "episode", "unresolved", "changed", "business", "refund", "other")] == [1, 1, 1, 1, 1, 1, 5]
    assert {r.category: r.total_cents for r in totals.category_totals(df, LedgerQuery()).collect()} == {"Food": -200, "Dental": 200, "Uncategorized": 900}
    assert filtered(df, LedgerQuery(category="Uncategorized")).count() == 0
    assert filtered(df, LedgerQuery(query="<PRINT>")).count() == 1
    needs = df.withColumns({"needs_category_review": F.col("id") == "0", "needs_item_review": F.when(F.col("id") == "1", True), "needs_scope_review": F.lit(None).cast("boolean")})
    assert needs.filter(matches_review(needs, "unresolved")).count() == 2
    got = [r[0] for r in needs.select(status(needs, LedgerQuery(business=True))).collect()]
    assert got == ["Category unresolved", "Items / use to review", "Category supported", "Scenario exclusion", "Category supported"]
    shown = df.withColumns({"direction": F.lit("outbound"), "kind": F.when(F.col("id") == "0", "transfer").otherwise("spend"), "evidence_summary": F.lit("")})
    assert [tuple(r) for r in shown.select(signed_amount(), evidence_text("none")).collect()][::4] == [(-100, "none"), (500, "Fine <print>")]


def test_adjustments_and_episodes_are_of_spending_in_the_category(spark):
    """A flagged income row, a flagged row of another category, and a category without spending."""
    df = small(
        spark, ("2031-09", 7, {"category": "Dental", "flags": ["nonroutine_dental_episode"]}), ("2031-09", 5, {"category": "Food", "flags": ["nonroutine_dental_episode", "business_candidate"]}),
        ("2031-09", 9, {"kind": "income", "category": "Payroll", "flags": ["business_candidate"]}), ("2031-09", 3, {"kind": "income", "category": "Dental", "flags": ["nonroutine_dental_episode"]}),
    )
    labels = [r[0] for r in df.select(status(df, LedgerQuery(business=True))).collect()]
    assert labels == ["Category supported", "Scenario exclusion", "Category supported", "Category supported"]
    r = rollup.overview(df, [2031 * 12 + 8], "Dental").first()
    assert (r.category_cents, r.category_rows, r.episode_cents, r.spending_cents, r.average_without_cents) == (700, 1, 700, 1200, 500)
    assert [r.category for r in totals.category_list(df).collect()] == ["Dental", "Food"]


def test_pages_tops_and_groups(spark):
    df = small(spark, *[("2031-09", k, {"category": f"c{k % 9}", "merchant": f"m{k % 2}"}) for k in range(65)])
    last = totals.page(df, [F.col("amount_cents").desc()], 99).collect()
    assert [r.amount_cents for r in last] == [400, 300, 200, 100, 0]
    own = totals.category_totals(df, LedgerQuery())
    top = totals.top_and_other(own, 6).collect()
    assert len(top) == 7 and sum(r.total_cents for r in top) == 208000
    assert max(r.share_permille for r in totals.share_of_largest(own).collect()) == 1000
    nested = totals.nested_merchant_groups(df).collect()
    assert sum(m.total_cents for r in nested for m in r.merchants) == 208000 and all(r.category_cents == sum(m.total_cents for m in r.merchants) for r in nested)


def test_empty_ledger(spark):
    df = small(spark, ("2031-09", 1)).limit(0)
    assert totals.category_totals(df, LedgerQuery()).count() == 0
    assert totals.summary(df, LedgerQuery()).first().spending_cents == 0
    assert compare.compare_month(df, covered(spark, *SUMMER), "2031-09", 3).count() == 0
    assert totals.page(df, [F.col("id")], 1).count() == 0


def test_pages_at_any_depth(spark):
    """Every page equals that of a plain sort, over hot dates and ids of one beginning; the last reads few rows."""
    dates = [date(2031, 9, 1)] * 60 + [date(2031, 9, d) for d in range(2, 12)] * 3 + [None] * 5
    rows = [(f"a{k % 7}{k:03}", x) for k, x in enumerate(dates)]
    df = spark.createDataFrame(rows, "id string, date date").repartition(5)
    order = [F.col("date").desc(), F.col("id").asc()]
    parts = [(F.col("date"), True), (F.substring("id", 1, 2), False), (F.substring("id", 1, 3), False)]
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    for most in (3, 1000):
        got = [[tuple(r) for r in totals.page(df, order, n, 7, parts, most).collect()] for n in range(1, 16)]
        assert got == [want[i : i + 7] for i in range(0, 95, 7)] + [want[91:]]
    plan = totals.page(df, order, 99, 7, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "date" in plan and "<=>" in plan or "isnull" in plan  # of the last range alone


def test_places_in_ranges_are_those_of_one_window(spark):
    """A category with most merchants, many of them equal, and negative totals."""
    from pyspark.sql import Window

    rows = [("hot", f"m{k:04}", (k * 7919) % 500 - 50 if k % 3 else 25) for k in range(900)] + [("cold", "x", -3), (None, "y", 0), (None, "z", 5), ("hot", "big", 10**13)]
    df = spark.createDataFrame(rows, "category string, merchant string, total_cents long")
    got = sorted(map(tuple, ranges.ranked(df, "category", "total_cents", "merchant", "place").collect()), key=str)
    plain = F.row_number().over(Window.partitionBy("category").orderBy(F.col("total_cents").desc(), "merchant"))
    assert got == sorted(map(tuple, df.withColumn("place", plain).collect()), key=str)
    plan = ranges.ranked(df, "category", "total_cents", "merchant", "place")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [row_number" in x]
    assert windows and all("__part" in x for x in windows)
    spread = df.select(ranges.log_range(F.col("total_cents")).alias("p"), "total_cents").orderBy("total_cents").collect()
    assert [r.p for r in spread] == sorted(r.p for r in spread)


def test_checks_read_the_ledger_once(spark, ledger, tmp_path):
    ledger.withColumn("evidence_basis", F.lit("synthetic_fixture")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    stored = spark.createDataFrame([(1, 1, 1, {"a": 1}, True)], "month_idx int, transaction_count long, spending_cents long, categories_cents map<string,long>, covered boolean")
    quarter = spark.createDataFrame([(1, {"a": 1}, 0)], "spending_cents long, categories_cents map<string,long>, episode_cents long")
    plan = quality.checks(rows, stored, ("spend",), ("sample-bank",), [], quarter)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_a_kept_rollup_follows_its_ledger(spark, ledger, tmp_path):
    """Appended in parts, in any order, it is that of all rows at once; months without new rows stay as written."""
    path, whole = str(tmp_path / "kept"), str(tmp_path / "whole")
    last = sample.FIRST_MONTH + 23
    files = lambda m: sorted(p.name for p in (tmp_path / "kept" / f"month_idx={m}").glob("*.parquet"))
    assert len(kept.append(ledger.filter("day(date) > 9"), path)) == 24
    before = files(last - 5), files(last)
    assert kept.append(ledger.filter(f"day(date) <= 9 AND month_idx = {last}"), path) == [last]
    assert (files(last - 5), files(last) != before[1]) == (before[0], True)
    assert len(kept.append(ledger.filter(f"day(date) <= 9 AND month_idx < {last}"), path)) == 23
    assert kept.append(ledger.limit(0), path) == []
    kept.append(ledger, whole)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(kept.read(spark, path)) == rows(kept.read(spark, whole))
    held = kept.read(spark, path)
    for of in (lambda df: rollup.monthly(df, "sample-card", "sample-bank"), lambda df: compare.compare_month(df, sample.months(spark), "2031-09", 3), lambda df: totals.summary(df, LedgerQuery(airfare=True)).drop("rows")):
        assert rows(of(held)) == rows(of(ledger))
    broken = held.withColumn("amount_cents", F.col("amount_cents") + (F.col("month_idx") == last).cast("int"))
    assert rows(rollup.monthly(broken, "sample-card", "sample-bank")) != rows(rollup.monthly(ledger, "sample-card", "sample-bank"))
    bad = ledger.withColumn("amount_cents", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        kept.append(bad, path)
    assert rows(kept.read(spark, path)) == rows(kept.read(spark, whole))


def test_distinct_merchants_of_any_months(spark):
    """Exact counts merge over months; estimates from merged sketches stay within five times the stated error."""
    rows = spark.range(60_000).selectExpr(
        "'spend' AS kind", "CAST(24000 + id % 6 AS INT) AS month_idx", "concat('m', (id * 7919) % 9001) AS merchant", "id % 11 = 0 AS classification_changed"
    )
    pairs = kept.merchant_months(rows.union(rows.limit(5).withColumn("merchant", F.lit(None).cast("string"))))
    for group in (F.lit(0), F.col("month_idx"), F.col("month_idx") % 2):
        exact = {r.months: (r.merchants, r.changed_merchants) for r in kept.distinct_merchants(pairs, group).collect()}
        plain = {r.months: (r.a, r.b) for r in rows.groupBy(group.alias("months")).agg(F.countDistinct("merchant").alias("a"), F.countDistinct(F.when(F.col("classification_changed"), F.col("merchant"))).alias("b")).collect()}
        assert exact == plain
        near = {r.months: (r.merchants, r.changed_merchants) for r in kept.estimated_merchants(kept.merchant_sketches(pairs), group).collect()}
        assert near.keys() == exact.keys()
        for k, found in exact.items():
            assert all(abs(a - b) <= 5 * 1.04 / 4096**0.5 * b for a, b in zip(near[k], found, strict=True))
