"""One household's data, definitions and scenario behind a small interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import js_round, month_from_index
from ledgerloom.plans import layers, plan, project, state
from ledgerloom.plans.definitions import TARGETS, Target, frame
from ledgerloom.sources.sample import FIRST_MONTH, MONTHS

#: Targets that a household can change at once; fixed values.
FLEXIBLE = ("groceries", "dining", "shopping")


class PlanSession:
    """Data as named tables, targets as definitions, and the inputs of one scenario.

    `set_plan_inputs` takes all inputs or, where one is unknown or out of range, none.
    """

    def __init__(self, spark: SparkSession, data: dict[str, DataFrame] | None = None, targets: tuple[Target, ...] = TARGETS):
        self.spark, self.data, self.targets = spark, data or {}, targets
        self._inputs: dict = {}

    def definitions(self) -> DataFrame:
        return frame(self.spark, self.targets)

    def _start(self) -> str:
        """The month after the ledger's last, or after the made-up one's."""
        latest = self.data["ledger"].agg(F.max("month_idx")).first()[0] if "ledger" in self.data else None
        return month_from_index(FIRST_MONTH + MONTHS if latest is None else latest + 1)

    def get_state(self) -> DataFrame:
        forecast = self._inputs.get("forecast") or layers.default_forecast(self._start())
        targets = layers.default_targets(self.targets) | self._inputs.get("targets", {})
        return state.scenario(self.spark, **self._inputs | {"forecast": forecast, "targets": targets})

    def set_plan_inputs(self, **inputs) -> DataFrame:
        forecast = inputs.pop("forecast", self._inputs.get("forecast"))
        merged = self._inputs | state.validated(inputs)
        if "targets" in inputs:
            merged["targets"] = self._inputs.get("targets", {}) | inputs["targets"]
        self._inputs = merged | ({"forecast": forecast} if forecast else {})
        return self.get_state()

    def reset(self) -> DataFrame:
        self._inputs = {}
        return self.get_state()

    def calculate(self) -> DataFrame:
        return plan.evaluate(self.get_state(), self.targets)

    def project(self) -> DataFrame:
        return project.project(self.get_state(), self.targets)


def flexible(plans: DataFrame) -> DataFrame:
    """By scenario, the flexible targets' total and a tenth of it, in cents."""
    own = [c for c in (f"t_{k}" for k in FLEXIBLE) if c in plans.columns]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in own), F.lit(0)).cast("long")
    return plans.select("scenario_id", total.alias("flexible_cents")).withColumn("tenth_cents", F.expr(js_round("(flexible_cents * CAST(0.1 AS DOUBLE))")))


def chart_bounds(projected: DataFrame) -> DataFrame:
    """By scenario, the least and largest balance of the start, every month, and zero."""
    known = F.filter(F.concat(F.array("current_cash_cents"), F.col("cashes"), F.array(F.lit(0).cast("long"))), lambda c: c.isNotNull())
    return projected.select("scenario_id", F.array_min(known).alias("least_cents"), F.array_max(known).alias("largest_cents"))
