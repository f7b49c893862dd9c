"""Layers of saved state over a default state: each a JSON document, merged field by field.

A document is parsed to VARIANT, so that a field that is absent, null, empty or of another
type is told apart at every depth, and what isn't valid leaves the layer below as it is:
an amount that is null or '' is unknown, one of a wrong type or out of range is ignored.
Every scenario is a row; a layer is a left join by its id and column expressions.

Documents may name their fields as the columns here or in camel case. A text that isn't
JSON, or no object, changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import LARGEST_AMOUNT
from ledgerloom.plans import state
from ledgerloom.plans.definitions import AUDITED, TARGETS, Target
from ledgerloom.plans.plan import INPUTS

TABS = ("overview", "spending", "plan", "future", "review")
ADJUSTMENTS = ("airfare", "business")
#: One-off costs and debts of a new forecast; fixed values.
ONEOFFS = ("Home repair", "Celebration", "Family setup")
DEBT_ENDS = ("vehicleA", "student", "vehicleB", "storeCard")
ONEOFF_LABEL = "One-off cost"
STARTS = ("start", "baby_start", "childcare_start", "leave_start")
#: Bounds of a forecast's numbers, and whether they are whole; fixed values.
NUMBERS = {"months": (1, 120, True), "leave_months": (0, 120, True), "income_growth": (0, 20, False), "expense_growth": (0, 20, False), "cash_yield": (0, 20, False)}
#: What a state has besides a scenario's inputs.
MORE = "adjustments struct<airfare:boolean,business:boolean>, checks map<string,boolean>, tab string, health_notice boolean, audit_notice boolean"


def default_forecast(start: str) -> dict:
    """A new forecast: 36 months from a month, nothing dated, nothing grown."""
    once = [{"label": label, "amount": None, "month": ""} for label in ONEOFFS]
    rest = {"months": 36, "leave_months": 0, "income_growth": 0.0, "expense_growth": 0.0, "cash_yield": 0.0}
    return dict.fromkeys(STARTS, "") | {"start": start} | rest | {"oneoffs": once, "debt_ends": dict.fromkeys(DEBT_ENDS, "")}


def default_targets(targets: tuple[Target, ...] = TARGETS) -> dict[str, float | None]:
    return {t.key: None if t.target is None else float(t.target) for t in targets}


def default_states(spark: SparkSession, ids: DataFrame, start: str, targets: tuple[Target, ...] = TARGETS) -> DataFrame:
    """A whole new state for each scenario_id."""
    one = state.scenario(spark, 0, targets=default_targets(targets), forecast=default_forecast(start)).drop("scenario_id")
    more = {
        "adjustments": F.struct(*[F.lit(False).alias(a) for a in ADJUSTMENTS]), "checks": F.create_map().cast("map<string,boolean>"), "tab": F.lit(TABS[0]),
        "health_notice": F.lit(False), "audit_notice": F.lit(False),
    }
    return ids.select(F.col("scenario_id").cast("long")).crossJoin(F.broadcast(one.withColumns(more)))  # a row


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.upper() if len(x) == 1 else x.title() for x in rest)


def _field(of: str, *names: str) -> str:
    """A field of a variant under the first of its names that it has; null where it is absent."""
    paths = dict.fromkeys(x for n in names for x in (n, _camel(n)))
    return f"coalesce({', '.join(f"try_variant_get({of}, '$.{n}', 'variant')" for n in paths)})"


def _kind(x: str, pattern: str) -> str:
    return f"schema_of_variant({x}) RLIKE '^({pattern})'"


def _number(x: str) -> str:
    return f"CASE WHEN {_kind(x, 'BIGINT|DECIMAL|DOUBLE')} THEN try_variant_get({x}, '$', 'double') END"


def _text(x: str) -> str:
    return f"CASE WHEN {_kind(x, 'STRING')} THEN try_variant_get({x}, '$', 'string') END"


def _bool(x: str) -> str:
    return f"CASE WHEN {_kind(x, 'BOOLEAN')} THEN try_variant_get({x}, '$', 'boolean') END"


def _entries(x: str) -> str:
    """An object's fields; null for anything else."""
    return f"CASE WHEN {_kind(x, 'OBJECT')} THEN try_variant_get({x}, '$', 'map<string,variant>') END"


def _one_of(x: str, choices: tuple[str, ...], base: str) -> str:
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"CASE WHEN ({_text(x)}) IN ({listed}) THEN {_text(x)} ELSE {base} END"


def _amount(x: str) -> str:
    return f"CASE WHEN ({_number(x)}) BETWEEN 0 AND {LARGEST_AMOUNT} THEN {_number(x)} END"


_FORECAST_FIELDS = ("start", "months", "baby_start", "childcare_start", "leave_start", "leave_months", "income_growth", "expense_growth", "cash_yield", "oneoffs", "debt_ends")
_MONTH = r"'\\A[0-9]{4}-(0[1-9]|1[0-2])\\z'"


def _dated(x: str, base: str) -> str:
    """A month or '' where the variant is one, else what was there."""
    return f"CASE WHEN ({_text(x)}) = '' OR ({_text(x)}) RLIKE {_MONTH} THEN {_text(x)} ELSE {base} END"


def _forecast(f: str) -> Column:
    """The merged forecast: its own valid fields over those of column `forecast`."""
    own = {c: _dated(_field(f, c), f"forecast.{c}") for c in STARTS}
    for c, (low, high, whole) in NUMBERS.items():
        n = _number(_field(f, c))
        test = f"({n}) BETWEEN {low} AND {high}" + (f" AND ({n}) = floor({n})" if whole else "")
        own[c] = f"CASE WHEN {test} THEN CAST({n} AS {'INT' if whole else 'DOUBLE'}) ELSE forecast.{c} END"
    label = f"CASE WHEN ({_number("try_variant_get(o, '$.label', 'variant')")}) = 0 OR NOT ({_bool("try_variant_get(o, '$.label', 'variant')")}) THEN NULL ELSE nullif(try_variant_get(o, '$.label', 'string'), '') END"
    amount, month = _amount("try_variant_get(o, '$.amount', 'variant')"), _dated("try_variant_get(o, '$.month', 'variant')", "''")
    item = f"named_struct('label', substring(coalesce({label}, '{ONEOFF_LABEL}'), 1, {state.LABEL}), 'amount', {amount}, 'month', {month})"
    once = _field(f, "oneoffs")
    listed = f"filter(slice(try_variant_get({once}, '$', 'array<variant>'), 1, {state.ONEOFFS}), o -> {_kind('o', 'OBJECT|ARRAY')})"
    own["oneoffs"] = f"CASE WHEN {_kind(once, 'ARRAY')} THEN transform({listed}, o -> {item}) ELSE forecast.oneoffs END"
    ends = _entries(_field(f, "debt_ends"))
    own["debt_ends"] = f"transform_values(forecast.debt_ends, (k, v) -> {_dated(f'try_element_at({ends}, k)', 'v')})"
    return F.struct(*[F.expr(own[c]).alias(c) for c in _FORECAST_FIELDS]).cast(state.FORECAST)


def merge_layer(states: DataFrame, saved: DataFrame, targets: tuple[Target, ...] = TARGETS) -> DataFrame:
    """The states with one layer over them. saved: (scenario_id, json), a row for each id at most.

    A version below 3 without a health mode whose targets have a medical one is of the combined
    plan, its dental target unknown; below 3 the audited targets become unknown; below 4 a review is due.
    """
    layer = saved.select(F.col("scenario_id").alias("__of"), F.try_parse_json("json").alias("__doc"))
    df = states.join(layer.filter(F.expr(_kind("__doc", "OBJECT|ARRAY"))), F.col("scenario_id") == F.col("__of"), "left").withColumn("__own", F.col("__of").isNotNull())
    version = _field("__doc", "version")
    number = f"CASE WHEN is_variant_null({version}) OR ({_text(version)}) = '' THEN 0D WHEN {_kind(version, 'BOOLEAN')} THEN CAST({_bool(version)} AS DOUBLE) ELSE coalesce({_number(version)}, try_cast({_text(version)} AS DOUBLE)) END"
    df = df.withColumns({"__version": F.expr(number), "__targets": F.expr(_entries(_field("__doc", "targets")))})
    mode = _field("__doc", "health_mode")
    listed = ", ".join(f"'{c}'" for c in state.CHOICES["health_mode"])
    df = df.withColumns(
        {
            "__legacy": F.expr("coalesce(__version < 3, false)"),
            "__migrated": F.expr(f"__own AND NOT coalesce(({_text(mode)}) IN ({listed}), false) AND coalesce(__version < 3 AND map_contains_key(__targets, 'medical'), false)"),
        }
    )
    out = {c: _one_of(_field("__doc", c), choices, c) for c, choices in state.CHOICES.items() if c != "health_mode"}
    out["health_mode"] = f"CASE WHEN ({_text(mode)}) IN ({listed}) THEN {_text(mode)} WHEN __migrated THEN 'combined' WHEN __own THEN 'separate' ELSE health_mode END"
    for c in INPUTS:
        x = _field("__doc", c)
        out[c] = f"CASE WHEN is_variant_null({x}) OR ({_text(x)}) = '' THEN NULL ELSE coalesce({_amount(x)}, {c}) END"
    keys = ", ".join(f"'{k}'" for k in [*(t.key for t in targets), *(key for _, key in AUDITED)])
    valid = f"map_filter(__targets, (k, x) -> k IN ({keys}) AND (is_variant_null(x) OR ({_amount('x')}) IS NOT NULL))"
    own = f"coalesce(transform_values({valid}, (k, x) -> {_amount('x')}), CAST(map() AS map<string,double>))"
    dental, blank = "map('dental', CAST(NULL AS DOUBLE))", ", ".join(f"'{key}', CAST(NULL AS DOUBLE)" for _, key in AUDITED)
    over = lambda below, above: f"map_concat(map_filter({below}, (k, x) -> NOT map_contains_key({above}, k)), {above})"
    df = df.withColumn("__new", F.expr(f"CASE WHEN __migrated THEN {over(f'({own})', dental)} ELSE {own} END"))
    df = df.withColumn("__base", F.expr(f"CASE WHEN __legacy THEN {over('targets', f'map({blank})')} ELSE targets END"))
    out["targets"] = over("__base", "__new")
    checks = _entries(_field("__doc", "checks"))
    df = df.withColumn("__checks", F.expr(f"coalesce(transform_values(map_filter({checks}, (k, x) -> {_kind('x', 'BOOLEAN')}), (k, x) -> {_bool('x')}), CAST(map() AS map<string,boolean>))"))
    out["checks"] = over("checks", "__checks")
    adjusted = _field("__doc", "adjustments")
    out["adjustments"] = "named_struct(" + ", ".join(f"'{a}', coalesce({_bool(_field(adjusted, a))}, adjustments.{a})" for a in ADJUSTMENTS) + ")"
    out["tab"] = _one_of(_field("__doc", "tab"), TABS, "tab")
    out["health_notice"] = f"CASE WHEN __migrated THEN true ELSE coalesce({_bool(_field('__doc', 'health_notice', 'health_migration_notice'))}, health_notice) END"
    out["audit_notice"] = f"CASE WHEN coalesce(__version < 4, false) THEN true ELSE coalesce({_bool(_field('__doc', 'audit_notice', 'audit_budget_notice'))}, audit_notice) END"
    merged = {c: F.expr(sql) for c, sql in out.items()} | {"forecast": F.when(F.expr(_kind(_field("__doc", "forecast"), "OBJECT|ARRAY")), _forecast(_field("__doc", "forecast"))).otherwise(F.col("forecast"))}
    return df.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in states.columns])


def merge_layers(states: DataFrame, *layers: DataFrame, targets: tuple[Target, ...] = TARGETS) -> DataFrame:
    """The states under every layer in turn: what a document embeds, then what was saved."""
    return reduce(lambda below, saved: merge_layer(below, saved, targets), layers, states)
