"""What changes a projection's months, as tables of events joined by intervals.

A debt that ends, a one-off cost and a leave are each an interval of months with an amount: from the
month after the debt's end on, the cost's own month, the months of leave. An interval is
entered in every bucket of `width` months that it reaches, and a scenario's month looks into its own
bucket only, so each pair that matches meets once and no scenario's months meet all of its
events. Unlike the arrays of `project`, a scenario may have any number of events here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.definitions import TARGETS, Target
from ledgerloom.plans.project import _prepared

KINDS = ("debt_reduction", "oneoff", "leave_reduction")


def calendar(prepared: DataFrame) -> DataFrame:
    """(scenario_id, i, month_idx): the projected months of every scenario."""
    each = prepared.select("scenario_id", "start_idx", F.explode(F.expr("sequence(0, months - 1)")).alias("i"))
    return each.select("scenario_id", "i", (F.col("start_idx") + F.col("i")).alias("month_idx"))


def long_events(prepared: DataFrame) -> DataFrame:
    """(scenario_id, kind, since, until, cents): a row for each event, both ends included."""
    last = F.col("start_idx") + F.col("months") - 1
    debts = prepared.select("scenario_id", last.alias("until"), F.inline("ends")).select("scenario_id", F.lit("debt_reduction").alias("kind"), (F.col("i") + 1).alias("since"), "until", F.col("c").alias("cents"))
    costs = prepared.select("scenario_id", F.inline("once")).select("scenario_id", F.lit("oneoff").alias("kind"), F.col("i").alias("since"), F.col("i").alias("until"), F.col("c").alias("cents"))
    leaves = prepared.select("scenario_id", F.lit("leave_reduction").alias("kind"), F.col("leave_idx").alias("since"), (F.col("leave_idx") + F.col("leave_months") - 1).alias("until"), F.col("reduction").alias("cents"))
    return debts.unionByName(costs).unionByName(leaves).filter("since <= until AND cents <> 0")


def event_sums(months: DataFrame, events: DataFrame, width: int = 12) -> DataFrame:
    """Each scenario's months with the sums of the events that they lie in, 0 where there are none.

    months: (scenario_id, i, month_idx); events: (scenario_id, kind, since, until, cents).
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("int")
    entered = events.select(F.col("scenario_id").alias("__of"), "kind", "since", "until", "cents", F.explode(F.sequence(bucket("since"), bucket("until"))).alias("__bucket"))
    same = (F.col("scenario_id") == F.col("__of")) & (bucket("month_idx") == F.col("__bucket")) & F.col("month_idx").between(F.col("since"), F.col("until"))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("cents"))), F.lit(0)).cast("long").alias(k)
    return months.join(entered, same, "left").groupBy("scenario_id", "i", "month_idx").agg(*map(total, KINDS))


def projected_events(scenarios: DataFrame, targets: tuple[Target, ...] = TARGETS) -> DataFrame:
    """The events' sums in every projected month: scenario_id, i, month_idx and a column for each kind."""
    prepared = _prepared(scenarios, targets)
    return event_sums(calendar(prepared), long_events(prepared))
