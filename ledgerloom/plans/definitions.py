"""The targets of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FIXED = ("mortgage", "vehicleA", "student", "vehicleB", "storeCard")


@dataclass(frozen=True)
class Target:
    key: str
    label: str
    cat: str | None = None
    essential: bool = False
    target: float | None = None
    personal: bool = False
    person_b: bool = False


#: The targets of a plan; fixed values.
TARGETS = (
    Target("mortgage", "Mortgage", "Mortgage", True),
    Target("energy", "Electricity + natural gas", None, True, 180),
    Target("municipal", "Municipal payments", "Municipal payments", True),
    Target("groceries", "Groceries & meal kits", "Groceries & meal kits", True),
    Target("dining", "Dining & drinks", "Dining & drinks"),
    Target("shopping", "Shopping & mixed retail", "Shopping & mixed retail"),
    Target("fuel", "Fuel & charging", "Fuel & charging", True),
    Target("vehicle", "Vehicle care & registration", "Vehicle care & registration"),
    Target("pets", "Pets", "Pets", True),
    Target("home", "Home purchases & maintenance", "Home & hardware"),
    Target("medical", "Medical & pharmacy", "Medical & pharmacy", True),
    Target("dental", "Dental reserve", "Dental", True),
    Target("travel", "Travel & parking", "Travel & parking"),
    Target("subscriptions", "Apps & subscriptions", "Apps & subscriptions"),
    Target("entertainment", "Entertainment", "Entertainment"),
    Target("phoneInsurance", "Phone, internet & other insurance", None, True),
    Target("cardFee", "Annual card-fee reserve", None, False, 10),
    Target("storeCard", "Store-card debt payment", None, True, 40),
    Target("vehicleA", "Person A vehicle payment", None, True, 180, personal=True),
    Target("student", "Education-loan payment", None, True, 220, personal=True),
    Target("vehicleB", "Person B vehicle payment", None, True, 300, person_b=True),
    Target("lifeInsurance", "Life-insurance allowance", None, True),
)

#: Categories that become targets where the baseline has them; fixed values.
AUDITED = (("Vision", "vision"), ("Uncategorized / review", "unclassified"))


def frame(spark: SparkSession, targets: tuple[Target, ...] = TARGETS) -> DataFrame:
    """The targets as a table."""
    rows = [(i, t.key, t.label, t.cat, t.essential, None if t.target is None else float(t.target), t.personal, t.person_b) for i, t in enumerate(targets)]
    return spark.createDataFrame(rows, "ord int, key string, label string, cat string, essential boolean, target double, personal boolean, person_b boolean")


def with_audited(spark: SparkSession, totals: DataFrame, targets: tuple[Target, ...] = TARGETS) -> tuple[Target, ...]:
    """The targets, and those of the audited categories that the baseline has."""
    names = [c for c, _ in AUDITED]
    seen = {r.category for r in totals.filter(totals.category.isin(names) & (totals.total_cents != 0)).select("category").distinct().collect()}
    return (*targets, *(Target(key, name, name) for name, key in AUDITED if name in seen))
