"""Scenario state: checking, migrating and storing inputs, each scenario a row; `layers` merges saved documents."""

from __future__ import annotations

import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import FREQUENCIES, LARGEST_AMOUNT
from ledgerloom.plans.definitions import TARGETS
from ledgerloom.plans.plan import INPUTS

#: Choices of the enumerated inputs; fixed values.
CHOICES = {
    "plan_mode": ("household", "joint"),
    "health_mode": ("combined", "separate"),
    "income_basis": ("regular", "average"),
    "vehicle_b_funding": ("unknown", "joint", "personal"),
    "person_a_frequency": ("", *FREQUENCIES),
    "person_b_frequency": ("", *FREQUENCIES),
}
#: A new scenario; fixed values.
DEFAULTS: dict = {
    "version": 4, "plan_mode": "household", "health_mode": "separate", "income_basis": "regular", "vehicle_b_funding": "unknown", "person_a_frequency": "", "person_b_frequency": "",
    "person_a_pay": 3000.0, "person_a_allocation": 350.0, "person_b_contribution": 2000.0, "other_income": 0.0, "leave_reduction": 0.0, "other_savings": 0.0,
}
FORECAST = "struct<start:string,months:int,baby_start:string,childcare_start:string,leave_start:string,leave_months:int,income_growth:double,expense_growth:double,cash_yield:double,oneoffs:array<struct<label:string,amount:double,month:string>>,debt_ends:map<string,string>>"
SCHEMA = (
    "scenario_id long, version int, " + ", ".join(f"{c} string" for c in CHOICES) + ", " + ", ".join(f"{c} double" for c in INPUTS) + f", targets map<string,double>, forecast {FORECAST}"
)
ONEOFFS, LABEL = 24, 80


def _over(below: Column, above: Column) -> Column:
    """The entries of one map, and those of another whose keys it lacks; null counts as empty."""
    none = F.create_map().cast("map<string,double>")
    above = F.coalesce(above, none)
    return F.map_concat(F.map_filter(F.coalesce(below, none), lambda k, _: ~F.map_contains_key(above, k)), above)


def migrate_health(df: DataFrame) -> DataFrame:
    """Old states without a health mode: combined, its dental target blank, where a version below 3 has a medical one."""
    valid = F.coalesce(F.col("health_mode").isin(*CHOICES["health_mode"]), F.lit(False))
    combined = ~valid & F.coalesce((F.col("version") < 3) & F.map_contains_key("targets", "medical"), F.lit(False))
    targets = F.map_concat(F.map_filter("targets", lambda k, _: k != "dental"), F.create_map(F.lit("dental"), F.lit(None).cast("double")))
    return df.withColumns(
        {
            "health_mode": F.when(valid, F.col("health_mode")).when(combined, "combined").otherwise("separate"),
            "targets": F.when(combined, targets).otherwise(F.col("targets")),
            "health_notice": combined,
            "version": F.lit(3),
        }
    )


def use_observed(df: DataFrame, observed_cents: dict[str, int], energy_cents: int | None = None) -> DataFrame:
    """Targets set to observed averages; a combined health plan keeps its medical and dental ones."""
    new = {k: v / 100 for k, v in observed_cents.items()} | ({} if energy_cents is None else {"energy": energy_cents / 100})
    both = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), F.lit(float(v)))])
    own = F.when(F.col("health_mode") == "combined", F.map_filter(both, lambda k, _: ~k.isin("medical", "dental"))).otherwise(both)
    return df.withColumn("targets", _over(F.col("targets"), own))


def validated(inputs: dict) -> dict:
    """The inputs of one scenario, all or none: an unknown name or a value out of range raises."""
    if not isinstance(inputs, dict):
        raise ValueError("inputs are a mapping of names to values")
    for k, v in inputs.items():
        if k in CHOICES:
            ok = v in CHOICES[k]
        elif k in INPUTS:
            ok = v is None or isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and 0 <= v <= LARGEST_AMOUNT
        elif k == "targets":
            ok = isinstance(v, dict) and all(x in {t.key for t in TARGETS} and (y is None or isinstance(y, (int, float)) and math.isfinite(y) and 0 <= y <= LARGEST_AMOUNT) for x, y in v.items())
        else:
            raise ValueError(f"unknown input: {k}")
        if not ok:
            raise ValueError(f"invalid value of {k}")
    return inputs


def scenario(spark: SparkSession, scenario_id: int = 0, **inputs) -> DataFrame:
    """One scenario: the defaults with checked inputs over them."""
    forecast = inputs.pop("forecast", None)
    known = {"scenario_id": scenario_id, "targets": {}} | DEFAULTS | validated(inputs)
    row = {f.name: known.get(f.name) for f in spark.createDataFrame([], SCHEMA).schema}
    row = {k: float(v) if k in INPUTS and v is not None else v for k, v in row.items()}
    row["targets"] = {k: None if v is None else float(v) for k, v in row["targets"].items()}
    row["forecast"] = forecast
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def _store(spark: SparkSession, path: str) -> tuple[object, object, list[int]]:
    """The file system, paths on it, and the store's committed versions in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at(path))] if fs.exists(at(path)) else []
    return fs, at, sorted(int(n[2:]) for n in names if n.startswith("v-"))


def _read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows that a version's pointer names."""
    folder = spark.read.text(f"{path}/v-{version}").first()
    if folder is None:
        raise FileNotFoundError(f"version {version} of {path} names no rows")
    return spark.read.parquet(f"{path}/{folder.value}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The scenarios as last saved."""
    _, _, versions = _store(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return _read_version(spark, path, versions[-1])


def save(df: DataFrame, path: str, attempts: int = 20) -> int:
    """Scenarios as Parquet; those of the same id are replaced. Returns the version that they are.

    A commit is optimistic. The rows of the next version, made of the last one, are written in a folder
    of their own; then the version is claimed by moving a pointer to that folder into its place,
    which fails if another writer was there first. The loser starts again from what the
    winner committed, so neither loses rows. A save that fails leaves the last version whole. The version
    before stays for those who read it; older ones go.
    """
    spark = df.sparkSession
    for _ in range(attempts):
        fs, at, versions = _store(spark, path)
        folder, version = f"rows-{uuid.uuid4().hex}", versions[-1] + 1 if versions else 1
        new = df
        if versions:
            old = _read_version(spark, path, versions[-1])
            new = old.join(df.select("scenario_id"), "scenario_id", "left_anti").select(*df.columns).unionByName(df)
        new.write.parquet(f"{path}/{folder}")
        if _claimed(spark, path, version, folder):
            for v in versions[:-1]:
                dropped = spark.read.text(f"{path}/v-{v}").first()
                fs.delete(at(f"{path}/{dropped.value}"), True)
                fs.delete(at(f"{path}/v-{v}"), False)
            return version
        fs.delete(at(f"{path}/{folder}"), True)
    raise RuntimeError(f"{path} changed {attempts} times while scenarios were saved")


def _claimed(spark: SparkSession, path: str, version: int, folder: str) -> bool:
    """Whether the version is ours: its pointer, whole before it is seen, is linked in if no other is there."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), conf)
    fs = at(path).getFileSystem(conf)
    mine = at(f"{path}/.{folder}")
    out = fs.create(mine, False)
    out.write(folder.encode())
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(mine, at(f"{path}/v-{version}"), none)  # unlike FileSystem's, it never replaces
        return True
    except Py4JJavaError as e:
        fs.delete(mine, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
