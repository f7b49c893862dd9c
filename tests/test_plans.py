"""Plans, projections, scenario state and scalar rules on small scenarios."""

from functools import reduce

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.functions import scalars
from ledgerloom.functions.periods import period
from ledgerloom.plans import events, definitions, layers, plan, project, state
from ledgerloom.scenarios import PLAN_TARGETS, scenarios

TARGETS = {"mortgage": 1100, "groceries": 500, "medical": 50, "dental": 75, "vehicleA": 180, "student": 220, "vehicleB": 300, "storeCard": 40}
INPUTS = {
    "plan_mode": "joint", "person_a_pay": 3000, "person_a_allocation": 350, "person_b_contribution": 2000, "other_expenses": 0, "childcare": 0, "baby_costs": 0,
    "home_fund": 100, "emergency_fund": 200, "anniversary_fund": 50, "current_cash": 2000, "cash_goal": 5000, "targets": TARGETS,
}
FORECAST = {"start": "2031-10", "months": 12, "baby_start": "2032-02", "childcare_start": "2032-02", "leave_start": "2032-02", "leave_months": 0, "income_growth": 0.0, "expense_growth": 0.0, "cash_yield": 0.0, "oneoffs": [], "debt_ends": {}}


def many(spark, *changes):
    """A scenario for each change of the usual inputs, numbered from 0."""
    rows = []
    for k, c in enumerate(changes):
        forecast = FORECAST | c.pop("forecast", {})
        targets = TARGETS | c.pop("targets", {})
        rows.append(state.scenario(spark, k, **(INPUTS | c | {"targets": targets, "forecast": forecast})))
    return reduce(DataFrame.unionByName, rows)


def by_id(df):
    return {r.scenario_id: r for r in df.collect()}


def test_plans(spark):
    semi = {"plan_mode": "household", "person_a_frequency": "semimonthly", "person_b_frequency": "semimonthly", "person_b_pay": 2000}
    got = by_id(
        plan.evaluate(
            many(spark, {}, {"plan_mode": "household"}, semi, {"person_a_frequency": "biweekly", "income_basis": "average"}, {"vehicle_b_funding": "joint"}, {"person_a_allocation": 9000}, {"health_mode": "combined"}, {"targets": {"groceries": None}}),
            PLAN_TARGETS,
        )
    )
    assert (got[0].income, got[0].expense, got[0].personal_debt, got[0].allowance) == (730000, 176500, 40000, 30000)
    assert got[0].uses_illustrative_two_checks and got[0].months_to_goal == 15 and got[0].savings == 35000
    assert got[1].income is None and got[1].missing == ["Person A pay frequency", "Person B full take-home and frequency", "Personal allocation monthly total"]
    assert (got[2].income, got[2].expense, got[2].missing) == (1000000, 276500, [])
    assert got[3].income == 774167
    assert got[4].expense == 176500 + 30000
    assert got[5].income is None and "Personal allocation exceeds take-home" in got[5].missing
    assert got[6].expense == 176500 - 7500
    assert got[7].blank_targets == ["Groceries & meal kits"] and got[7].incomplete[-1] == "Groceries & meal kits" and got[7].expense == 126500
    lines = plan.breakdown(plan.evaluate(many(spark, {}), PLAN_TARGETS)).orderBy("line").collect()
    assert [r.cents for r in lines] == [730000, 176500, 35000, 518500, 0, 0, 518500]
    assert lines[0].label == "Joint funding"
    goals = plan.goal_status(plan.evaluate(many(spark, {}, {"cash_goal": 1}, {"cash_goal": None}, {"emergency_fund": 0}), PLAN_TARGETS)).orderBy("scenario_id").collect()
    assert [r.status for r in goals] == ["reached", "covered", "inputs_open", "no_contribution"] and goals[0].months == 15


def test_projections(spark):
    once = [{"label": "Roof", "amount": 1800.0, "month": "2032-01"}]
    df = many(
        spark, {}, {"forecast": {"oneoffs": once}}, {"childcare": 1200, "baby_costs": 200}, {"leave_reduction": 1000, "forecast": {"leave_months": 2}}, {"targets": {"groceries": 12000}, "forecast": {"cash_yield": 5.0}},
        {"forecast": {"debt_ends": {"storeCard": "2031-11"}}}, {"forecast": {"expense_growth": 12.0, "months": 13}}, {"cash_goal": 500}, {"cash_goal": 1e8}, {"plan_mode": "household"},
        {"other_savings": 700}, {"forecast": {"oneoffs": [{"label": "Roof", "amount": 5.0, "month": None}, {"label": "Car", "amount": None, "month": "2031-12"}]}},
    )
    projected = project.project(df, PLAN_TARGETS).cache()
    steps = {}
    for r in project.rows(projected).orderBy("scenario_id", "i").collect():
        steps.setdefault(r.scenario_id, []).append(r)
    end = by_id(project.milestones(projected))
    assert {s.net for s in steps[0]} == {553500} and {s.unassigned for s in steps[0]} == {518500} and end[0].end_cash == 200000 + 12 * 553500
    assert end[1].end_cash == end[0].end_cash - 180000 and [s.oneoff for s in steps[1]] == [0, 0, 0, 180000] + [0] * 8
    assert [s.baby for s in steps[2]][3:5] == [0, 140000]
    assert [s.leave_reduction for s in steps[3]][3:7] == [0, 100000, 100000, 0] and steps[3][4].income == 630000
    assert end[4].first_deficit == end[4].first_negative_cash == "2031-10" and steps[4][1].interest == 0 and steps[4][0].interest == 815
    assert [s.debt_reduction for s in steps[5]][1:3] == [0, 4000]
    assert steps[6][12].expense == 114000 + 70000 and steps[6][12].month == "2032-10"
    assert (end[7].goal_reached, end[8].goal_reached, end[0].goal_reached) == (0, None, 1)
    assert end[9].end_cash is None and not end[9].complete and steps[9][0].interest == 0
    assert end[10].end_cash == end[0].end_cash
    missing = {r.scenario_id: r.projection_missing for r in projected.collect()}
    assert missing[11][-2:] == ["Roof month", "Car amount"] and "Person A’s actual pay frequency" in missing[0]
    assert project.rows(projected).count() == 11 * 12 + 13
    bounds = by_id(session.chart_bounds(projected))
    assert bounds[0].least_cents == 0 and bounds[0].largest_cents == end[0].end_cash


@pytest.mark.parametrize("wrong", [{"months": 0}, {"months": 121}, {"start": "2031-13"}, {"cash_yield": 21.0}, {"leave_months": 121}])
def test_projection_limits(spark, wrong):
    with pytest.raises(PySparkException):
        project.project(many(spark, {"forecast": wrong}), PLAN_TARGETS).select("cashes").collect()


def test_rounding_and_cents(spark):
    value = lambda sql: spark.sql(f"SELECT {sql} AS x").first().x
    assert [value(scalars.js_round(f"CAST({x} AS DOUBLE)")) for x in ("-2.5", "2.5", "0.49999999999999994", "-0.5")] == [-2, 3, 0, 0]
    assert [value(scalars.checked_cents(f"CAST({x} AS DOUBLE)")) for x in ("0.285", "1.005", "8.165", "0", "1.23", "NULL")] == [29, 101, 817 if round(8.165 * 100 + 2e-14) == 817 else 816, 0, 123, None]
    for x in ("-1", "'Infinity'", "'NaN'", "1e9"):
        with pytest.raises(PySparkException):
            value(scalars.checked_cents(f"CAST({x} AS DOUBLE)"))
    assert value(scalars.split_health("250", "75")) == 175.0
    with pytest.raises(PySparkException):
        value(scalars.split_health("50", "51"))
    assert [scalars.month_index(x) for x in ("2031-09", "2031-13", "2031-9", "", "2031-09\n")] == [2031 * 12 + 8, None, None, None, None]
    assert scalars.month_from_index(2031 * 12) == "2031-01"
    texts = spark.sql("SELECT 123456789L AS a, -5L AS b, CAST(NULL AS BIGINT) AS c").select(*[scalars.money(F.col(c)) for c in "abc"]).first()
    assert tuple(texts) == ("$1,234,567.89", "-$0.05", "Not set")
    assert spark.sql("SELECT '<a b=\"1\">&' AS t").select(scalars.escape_html(F.col("t"))).first()[0] == "&lt;a b=&quot;1&quot;&gt;&amp;"


def test_periods():
    first, latest, base = 2029 * 12 + 9, 2031 * 12 + 8, (2031 * 12 + 6, 2031 * 12 + 8)
    of = lambda n: (p := period(n, first, latest, base), (p.start, p.end, p.months))[1]
    assert of("quarter") == ("2031-07-01", "2031-10-01", 3)
    assert of("ytd") == ("2031-01-01", "2031-10-01", 9)
    assert of("previousYear") == ("2030-01-01", "2031-01-01", 12)
    assert of("all") == ("2029-10-01", "2031-10-01", 24)
    assert of("2031-02") == ("2031-02-01", "2031-03-01", 1)
    with pytest.raises(ValueError):
        of("2031-00")


def test_state(spark, tmp_path):
    for wrong in ({"plan_mode": "solo"}, {"person_a_pay": -1}, {"person_a_pay": True}, {"nothing": 1}, {"targets": {"food": 1}}, {"cash_goal": 1e9}):
        with pytest.raises(ValueError):
            state.validated(wrong)
    old = state.scenario(spark, 1, targets={"medical": 250.0, "dental": 10.0}).withColumns({"version": F.lit(2), "health_mode": F.lit(None).cast("string")})
    r = state.migrate_health(old).first()
    assert (r.health_mode, r.targets, r.health_notice, r.version) == ("combined", {"medical": 250.0, "dental": None}, True, 3)
    assert old.first().targets["dental"] == 10.0
    r = state.migrate_health(old.withColumn("version", F.lit(None).cast("int"))).first()
    assert r.health_mode == "separate" and not r.health_notice
    r = state.use_observed(state.scenario(spark, 1, health_mode="combined", targets={"medical": 9.0}), {"medical": 100, "fuel": 1200}, 500).first()
    assert r.targets == {"medical": 9.0, "fuel": 12.0, "energy": 5.0}
    path = str(tmp_path / "scenarios")
    state.save(many(spark, {}, {}), path)
    state.save(state.scenario(spark, 1, person_a_pay=77), path)
    assert {r.scenario_id: r.person_a_pay for r in state.load(spark, path).collect()} == {0: 3000.0, 1: 77.0}
    bad = state.scenario(spark, 2).withColumn("person_a_pay", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        state.save(bad, path)
    assert {r.scenario_id for r in state.load(spark, path).collect()} == {0, 1}
    for n in (5, 6):
        state.save(state.scenario(spark, n), path)
    assert {r.scenario_id for r in state.load(spark, path).collect()} == {0, 1, 5, 6}


def merged(spark, *documents, base=None):
    """The default state of scenario 1 under documents, in turn."""
    if base is None:
        base = layers.default_states(spark, spark.createDataFrame([(1,)], "scenario_id long"), "2031-10")
    return layers.merge_layers(base, *[spark.createDataFrame([(1, d)], "scenario_id long, json string") for d in documents]).first()


def test_layers_tell_unknown_from_absent_and_from_wrong(spark):
    a = merged(spark, '{"version": 4, "otherIncome": null, "personAPay": "", "planMode": "joint", "targets": {"dining": null, "fuel": 7, "food": 1, "student": -1, "cardFee": ""}}')
    assert (a.other_income, a.person_a_pay, a.plan_mode, a.person_b_contribution, a.version) == (None, None, "joint", 2000.0, 4)
    assert (a.targets["fuel"], a.targets["student"], a.targets["cardFee"], "food" in a.targets) == (7.0, 220.0, 10.0, False) and not a.audit_notice
    b = merged(spark, '{"person_a_pay": "abc", "person_b_contribution": true, "cash_goal": 900000000, "person_a_frequency": "daily", "tab": "none", "checks": {"income": "yes", "baby": true}, "adjustments": {"airfare": 1, "business": true}}')
    assert (b.person_a_pay, b.person_b_contribution, b.cash_goal, b.person_a_frequency, b.tab, b.checks) == (3000.0, 2000.0, None, "", "overview", {"baby": True})
    assert tuple(b.adjustments) == (False, True) and not b.audit_notice
    whole = merged(spark)
    for text in ("not json", "null", "3", '"text"', "[1]", "", None):
        assert merged(spark, text) == whole


def test_forecasts_merge_field_by_field(spark):
    f = merged(spark, '{"forecast": {"months": 500, "cashYield": 4, "leaveMonths": 2.5, "babyStart": "2032-13", "childcareStart": "2032-04", "start": null}}').forecast
    assert (f.months, f.cash_yield, f.leave_months, f.baby_start, f.childcare_start, f.start) == (36, 4.0, 0, "", "2032-04", "2031-10")
    assert [(o.label, o.amount, o.month) for o in f.oneoffs] == [(n, None, "") for n in ("Home repair", "Celebration", "Family setup")]
    f = merged(spark, '{"forecast": {"oneoffs": [{"label": "", "amount": -1, "month": "x"}, 3, null, {"label": 7, "amount": "5"}, {"label": "Roof", "amount": 5, "month": "2032-01"}], "debtEnds": {"student": "2031-12", "car": "2031-12", "vehicleB": "x"}}}', '{"forecast": {"months": 60, "debtEnds": {"student": ""}}}').forecast
    assert [(o.label, o.amount, o.month) for o in f.oneoffs] == [("One-off cost", None, ""), ("7", None, ""), ("Roof", 5.0, "2032-01")]
    assert f.months == 60 and f.debt_ends == {"vehicleA": "", "student": "", "vehicleB": "", "storeCard": ""}
    many = ",".join('{"label": "' + "x" * 90 + '"}' for _ in range(30))
    once = merged(spark, '{"forecast": {"oneoffs": [' + many + "]}}").forecast.oneoffs
    assert len(once) == 24 and {len(o.label) for o in once} == {80}


def test_old_states_are_migrated(spark):
    r = merged(spark, '{"version": 2, "targets": {"medical": 150, "student": 210, "dining": 125}, "personAPay": 3200, "personAFrequency": "weekly", "currentCash": 2500, "checks": {"income": true}}')
    assert (r.health_mode, r.health_notice, r.audit_notice, r.person_a_pay, r.current_cash, r.checks) == ("combined", True, True, 3200.0, 2500.0, {"income": True})
    assert [r.targets[k] for k in ("medical", "dental", "student", "dining", "vision", "unclassified")] == [150.0, None, 210.0, 125.0, None, None]
    r = merged(spark, '{"version": 3, "targets": {"medical": 1}, "auditBudgetNotice": false}')
    assert (r.health_mode, r.health_notice, r.audit_notice) == ("separate", False, True)
    r = merged(spark, '{"version": 4, "healthMode": "combined", "auditBudgetNotice": true, "healthMigrationNotice": true}', '{"version": 4, "tab": "plan"}')
    assert (r.health_mode, r.health_notice, r.audit_notice, r.tab) == ("separate", True, True, "plan")


def test_a_saved_state_round_trips(spark, tmp_path):
    """What the store keeps is what layers made, notices, points checked and all; a fresh copy projects."""
    base = layers.default_states(spark, spark.createDataFrame([(1,)], "scenario_id long"), "2031-10")
    saved = spark.createDataFrame([(1, '{"checks": {"income": true}, "tab": "future", "adjustments": {"airfare": true}, "forecast": {"months": 60}}')], "scenario_id long, json string")
    state.save(layers.merge_layers(base, saved), str(tmp_path / "s"))
    r = state.load(spark, str(tmp_path / "s")).first()
    assert (r.checks, r.tab, r.adjustments.airfare, r.forecast.months) == ({"income": True}, "future", True, 60)


def test_lists_of_the_review(spark):
    assert plan.debt_inventory(spark).count() == 5
    rows = spark.createDataFrame([(1, {"income": True, "baby": False}), (2, None)], "scenario_id long, checks map<string,boolean>")
    got = {(r.scenario_id, r.id) for r in plan.checklist(rows).collect() if r.checked}
    assert got == {(1, "income")} and plan.checklist(rows).count() == 16


def test_audited_targets(spark):
    seen = spark.createDataFrame([("Vision", 100), ("Uncategorized / review", 0), ("Dining", 5)], "category string, total_cents long")
    assert [t.key for t in definitions.with_audited(spark, seen)[len(definitions.TARGETS) :]] == ["vision"]


def test_session(spark):
    b = session.PlanSession(spark, targets=PLAN_TARGETS)
    b.set_plan_inputs(**INPUTS, forecast=FORECAST)
    assert b.calculate().first().income == 730000
    with pytest.raises(ValueError):
        b.set_plan_inputs(person_a_pay=5000, unknown=1)
    assert b.get_state().first().person_a_pay == 3000.0
    assert len(b.project().first().cashes) == 12 and b.definitions().count() == len(PLAN_TARGETS)
    r = session.flexible(b.calculate()).first()
    assert (r.flexible_cents, r.tenth_cents) == (50000, 5000)
    assert b.reset().first().person_b_contribution == 2000.0
    fresh = session.PlanSession(spark).project().first()
    assert len(fresh.cashes) == 36 and fresh.forecast.start == "2031-10" and fresh.targets["student"] == 220.0
    rows = spark.createDataFrame([(2040 * 12 + 11,)], "month_idx int")
    assert session.PlanSession(spark, {"ledger": rows}).get_state().first().forecast.start == "2041-01"


def test_two_writers_both_survive(spark, tmp_path):
    """Writers that start from the same version: the later one starts again from what the other committed."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "s")
    state.save(many(spark, {}), path)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda n: state.save(state.scenario(spark, n, person_a_pay=n), path), range(10, 14)))
    assert sorted(versions) == [2, 3, 4, 5]
    assert {r.scenario_id for r in state.load(spark, path).collect()} == {0, 10, 11, 12, 13}
    assert state._claimed(spark, path, 5, "rows-late") is False
    assert {r.scenario_id for r in state.load(spark, path).collect()} == {0, 10, 11, 12, 13}


def test_rules_in_plain_sql(spark):
    from ledgerloom.functions import sql

    assert set(sql.register(spark)) >= {"round_half_up", "months_between_names"}
    r = spark.sql("SELECT round_half_up(-2.5D) AS a, dollars_to_cents(1.23D) AS b, dollars_to_cents(NULL) AS c, paychecks_a_month('biweekly', 'average') AS d, month_number('2031-09') AS e, month_name(24380) AS f").first()
    assert tuple(r) == (-2, 123, None, 26 / 12, 2031 * 12 + 8, "2031-09")
    reviews = spark.sql("SELECT needs_review(NULL, NULL, NULL, NULL, 'provisional', NULL) AS a, needs_review(false, NULL, NULL, true, 'provisional', NULL) AS b, needs_review(NULL, NULL, NULL, NULL, 'high', array('Mixed_Retail')) AS c").first()
    assert tuple(reviews) == (True, False, True)
    assert [tuple(r) for r in spark.sql("SELECT * FROM months_between_names('2031-11', '2032-02') ORDER BY month_idx").collect()] == [(24382, "2031-11"), (24383, "2031-12"), (24384, "2032-01"), (24385, "2032-02")]
    with pytest.raises(PySparkException):
        spark.sql("SELECT dollars_to_cents(-1D)").collect()


def test_events_by_intervals_equal_the_arrays(spark):
    """Of every scenario and month the interval join has what the arrays have; a match on a bucket's edge counts once."""
    once = [{"label": f"c{k}", "amount": 10.0 * k, "month": f"203{2 + k // 12}-{k % 12 + 1:02}"} for k in range(24)]
    df = many(
        spark, {"forecast": {"oneoffs": once, "months": 60}}, {"leave_reduction": 1000, "forecast": {"leave_start": "2031-12", "leave_months": 14, "months": 40}}, {"forecast": {"debt_ends": {"student": "2032-12", "vehicleA": "2031-09"}, "months": 120}},
    )
    want = {(r.scenario_id, r.i): (r.debt_reduction, r.oneoff, r.leave_reduction or 0) for r in project.rows(project.project(df, PLAN_TARGETS)).collect()}
    for width in (1, 5, 12, 500):
        prepared = project._prepared(df, PLAN_TARGETS)
        got = events.event_sums(events.calendar(prepared), events.long_events(prepared), width).collect()
        assert {(r.scenario_id, r.i): (r.debt_reduction, r.oneoff, r.leave_reduction) for r in got} == want and len(got) == len(want)


def test_projections_are_dealt_to_all_tasks(spark):
    """Though the customers are one row group, every task has about as many scenarios to project."""
    projected = project.project(scenarios(spark, "/root/testdata/sf0.01"), PLAN_TARGETS)
    for df in (project.rows(projected).filter("i = 0"), project.milestones(projected), session.chart_bounds(projected)):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)
