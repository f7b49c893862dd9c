"""Month-by-month cash of every scenario at once.

Everything but the cash balance depends on the month's number alone. The balance is a
recurrence with rounding: it is folded inside the row over an array of the months' net
amounts, so scenarios stay independent and nothing is shuffled. The months' other fields are
plain columns of the exploded rows, which are compiled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import checked_cents, js_round, month_index_sql, month_text
from ledgerloom.plans.definitions import FIXED, TARGETS, Target
from ledgerloom.plans.plan import _sum, evaluate

_RANGE = "raise_error('choose a start month, 1 to 120 months, rates from 0 to 20 percent, and 0 to 120 months of leave')"


def _scope(t: Target) -> str:
    tests = (["whole"] if t.personal else []) + (["(whole OR coalesce(vehicle_b_funding, '') = 'joint')"] if t.person_b else [])
    return " AND ".join(tests) or "true"


def _prepared(scenarios: DataFrame, targets: tuple[Target, ...]) -> DataFrame:
    df = evaluate(scenarios, targets)
    at = {c: F.expr(month_index_sql(f"forecast.{f}")) for c, f in (("start_idx", "start"), ("baby_idx", "baby_start"), ("childcare_idx", "childcare_start"), ("leave_idx", "leave_start"))}
    df = df.withColumns(at)
    rates = {f"{r}_rate": F.expr(f"coalesce(forecast.{r}, 0D) / 100D") for r in ("income_growth", "expense_growth", "cash_yield")}
    df = df.withColumns({**rates, "months": F.expr("forecast.months"), "leave_months": F.expr("coalesce(forecast.leave_months, 0)")})
    wrong = "start_idx IS NULL OR coalesce(months, 0) NOT BETWEEN 1 AND 120 OR leave_months NOT BETWEEN 0 AND 120 OR " + " OR ".join(f"isnan({r}_rate) OR {r}_rate NOT BETWEEN 0 AND 0.2D" for r in ("income_growth", "expense_growth", "cash_yield"))
    df = df.withColumn("months", F.expr(f"CASE WHEN {wrong} THEN {_RANGE} ELSE months END"))
    fixed = _sum([f"CASE WHEN {_scope(t)} THEN coalesce(t_{t.key}, 0L) ELSE 0L END" for t in targets if t.key in FIXED])
    ends = ", ".join(f"named_struct('i', {month_index_sql(f'''forecast.debt_ends['{t.key}']''')}, 'c', CASE WHEN {_scope(t)} THEN coalesce(t_{t.key}, 0L) ELSE 0L END)" for t in targets)
    once = f"transform(coalesce(forecast.oneoffs, array()), o -> named_struct('i', {month_index_sql('o.month')}, 'c', {checked_cents('o.amount')}, 'label', o.label))"
    return df.withColumns(
        {
            "fixed": F.expr(f"{fixed} + CASE WHEN whole THEN coalesce(allowance, 0L) ELSE 0L END"),
            "ends": F.expr(f"filter(array({ends}), e -> e.i IS NOT NULL AND e.c <> 0)"),
            "once": F.expr(once),
        }
    )


def _missing(df: DataFrame) -> DataFrame:
    """The names of what the projection lacks, in order and once each."""
    tests = [
        ("current_cash_cents IS NULL", "Starting available cash"),
        ("coalesce(baby_costs_cents, 0) > 0 AND baby_idx IS NULL", "Baby-cost start month"),
        ("coalesce(childcare_cents, 0) > 0 AND childcare_idx IS NULL", "Childcare start month"),
        ("uses_illustrative_two_checks", "Person A’s actual pay frequency"),
        ("leave_months > 0 AND leave_reduction_cents IS NULL", "Monthly leave-income reduction"),
        ("reduction > 0 AND leave_months > 0 AND leave_idx IS NULL", "Leave-income reduction start month"),
    ]
    own = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(label)) for c, label in tests]))
    once = F.expr("flatten(transform(once, o -> array_compact(array(CASE WHEN o.c > 0 AND o.i IS NULL THEN concat(o.label, ' month') END, CASE WHEN o.i IS NOT NULL AND o.c IS NULL THEN concat(o.label, ' amount') END))))")
    return df.withColumn("projection_missing", F.array_distinct(F.concat("incomplete", own, once)))


_IDX = "(start_idx + i)"
_REDUCTION = f"CASE WHEN {_IDX} >= leave_idx AND {_IDX} < leave_idx + leave_months THEN reduction ELSE 0L END"
_DEBT = f"aggregate(filter(ends, e -> {_IDX} > e.i), 0L, (a, e) -> a + e.c)"
_BABY = f"((CASE WHEN {_IDX} >= baby_idx THEN coalesce(baby_costs_cents, 0L) ELSE 0L END) + (CASE WHEN {_IDX} >= childcare_idx THEN coalesce(childcare_cents, 0L) ELSE 0L END))"


def _grown(amount: str, rate: str) -> str:
    return js_round(f"({amount} * power(1D + {rate}_rate, i / 12D))")


#: The fields of month i of a scenario, as SQL.
_FLOWS = {
    "income": f"{_grown('income', 'income_growth')} - {_REDUCTION}",
    "expense": f"{_grown('(expense - fixed)', 'expense_growth')} + fixed - {_DEBT}",
    "baby": _grown(_BABY, "expense_growth"),
    "oneoff": f"aggregate(filter(once, o -> o.i = {_IDX}), 0L, (a, o) -> a + coalesce(o.c, 0L))",
    "debt_reduction": _DEBT,
    "leave_reduction": _REDUCTION,
}


def _interest(opening: str) -> str:
    return f"(CASE WHEN {opening} IS NOT NULL THEN {js_round(f'(greatest(0L, {opening}) * month_yield)')} END)"


def project(scenarios: DataFrame, targets: tuple[Target, ...] = TARGETS) -> DataFrame:
    """The scenarios with `nets` and `cashes` (arrays with an entry for each month) and `projection_missing`."""
    df = _missing(_prepared(scenarios, targets)).withColumn("month_yield", F.expr("power(1D + cash_yield_rate, 1D / 12D) - 1D"))
    net = " - ".join(f"({_FLOWS[f]})" for f in ("income", "expense", "baby", "oneoff"))
    df = df.withColumn("nets", F.expr(f"transform(sequence(0, months - 1), i -> {net})"))
    step = f"a.cash + x + {_interest('a.cash')}"
    fold = f"aggregate(nets, named_struct('cash', current_cash_cents, 'all', CAST(array() AS array<bigint>)), (a, x) -> transform(array({step}), c -> named_struct('cash', c, 'all', concat(a.all, array(c))))[0], a -> a.all)"
    return df.withColumn("cashes", F.expr(fold))


def rows(projected: DataFrame) -> DataFrame:
    """One row for each scenario and month.

    There is a step at least, so the outer explode adds no row; the plain one would push
    a filter on the array's size, and with it the whole fold, down to the scan.
    """
    kept = ["scenario_id", "start_idx", "savings", "current_cash_cents", "cashes", "month_yield", *_READ]
    each = projected.select(*kept, F.posexplode_outer("nets").alias("i", "net"))
    each = each.withColumn("opening", F.expr("CASE WHEN i = 0 THEN current_cash_cents ELSE try_element_at(cashes, i) END"))
    flows = {name: F.expr(sql).alias(name) for name, sql in _FLOWS.items()}
    return each.select(
        "scenario_id", "i", F.expr(month_text(_IDX)).alias("month"), flows["income"], flows["expense"], flows["baby"], flows["oneoff"], "net", F.col("savings").alias("planned_savings"),
        F.expr("net - savings").alias("unassigned"), F.expr(_interest("opening")).alias("interest"), F.expr("try_element_at(cashes, i + 1)").alias("cash"), flows["debt_reduction"], flows["leave_reduction"],
    )


#: What the months' fields are made of.
_READ = ["income", "expense", "fixed", "reduction", "leave_idx", "leave_months", "ends", "once", "baby_idx", "childcare_idx", "baby_costs_cents", "childcare_cents", "income_growth_rate", "expense_growth_rate"]


def milestones(projected: DataFrame) -> DataFrame:
    """One row a scenario: end cash, first deficit, first negative cash, months to the goal, completeness."""
    first = lambda of, test: f"nullif(array_position(transform({of}, x -> coalesce({test}, false)), true), 0L)"
    month = lambda of: F.expr(month_text(f"(start_idx + CAST({first(of, 'x < 0')} AS INT) - 1)"))
    reached = f"CASE WHEN current_cash_cents >= cash_goal_cents THEN 0 ELSE CAST({first('cashes', 'x >= cash_goal_cents')} AS INT) END"
    return projected.select(
        "scenario_id",
        F.expr("element_at(cashes, -1)").alias("end_cash"),
        month("nets").alias("first_deficit"),
        month("cashes").alias("first_negative_cash"),
        F.expr(reached).alias("goal_reached"),
        F.expr("nets[0] - savings").alias("first_unassigned"),
        F.col("savings").alias("planned_savings"),
        (F.size("projection_missing") == 0).alias("complete"),
        F.size("projection_missing").alias("missing_count"),
    )
