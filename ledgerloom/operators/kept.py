"""A rollup that is kept: partial sums of a ledger by month, merged as rows arrive.

The stored rows are sums of all ledger rows that agree in month, kind, source, both categories,
flags and sign, and count them. They have the columns of a ledger row, so whatever sums
ledger rows (months, categories, comparisons, refunds) reads them in its place, at the size of the
calendar times the categories. The table is partitioned by month, and an append rewrites
the months that it has rows of, and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import shared_path

KEYS = ("month_idx", "kind", "source", "category", "source_category", "flags", "refund")


def partial_sums(df: DataFrame) -> DataFrame:
    """Ledger rows, or partial sums of some, as partial sums; sums of sums are the same."""
    if "rows" not in df.columns:
        listed = F.array_sort(F.array_distinct(F.coalesce("flags", F.array().cast("array<string>"))))
        df = df.withColumns({"flags": listed, "refund": F.coalesce(F.col("amount_cents") < 0, F.lit(False)), "rows": F.lit(1).cast("long")})
    return df.groupBy(*KEYS).agg(F.sum("amount_cents").cast("long").alias("amount_cents"), F.sum("rows").cast("long").alias("rows"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def append(df: DataFrame, path: str) -> list[int]:
    """Add ledger rows to the rollup at a path, and say which months changed.

    The merged months are written beside the table first, so that rows which can't be
    read leave it as it is.
    """
    spark = df.sparkSession
    staged = shared_path(spark, "arrived")
    partial_sums(df).write.parquet(staged)
    new = spark.read.parquet(staged)
    months = sorted(r.month_idx for r in new.select("month_idx").distinct().collect())  # a calendar's
    if not months:
        return []
    if _exists(spark, path):
        old = spark.read.parquet(path).filter(F.col("month_idx").isin(months))
        merged = shared_path(spark, "merged")
        partial_sums(old.unionByName(new)).write.parquet(merged)
        new = spark.read.parquet(merged)
    out = new.repartition("month_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("month_idx").parquet(path)
    return months


def read(spark: SparkSession, path: str) -> DataFrame:
    """The partial sums, as rows of a ledger with a count."""
    return spark.read.parquet(path)


#: Registers of a sketch, as a power of two: its relative error is about 1.04 / sqrt(4096), 1.6 %, two times of three.
SKETCH = 12


def merchant_months(df: DataFrame) -> DataFrame:
    """(month_idx, merchant, rows, changed_rows) of spending: the exact form, from which distinct merchants of any months follow."""
    own = df.filter(F.col("kind") == "spend")
    changed = F.count_if(F.coalesce("classification_changed", F.lit(False)))
    return own.groupBy("month_idx", "merchant").agg(F.count(F.lit(1)).alias("rows"), changed.alias("changed_rows"))


def merchant_sketches(pairs: DataFrame) -> DataFrame:
    """(month_idx, merchants, changed_merchants): a sketch of each month's merchants, of fixed size; sketches of months merge."""
    changed = F.when(F.col("changed_rows") > 0, F.col("merchant"))
    return pairs.groupBy("month_idx").agg(F.hll_sketch_agg("merchant", SKETCH).alias("merchants"), F.hll_sketch_agg(changed, SKETCH).alias("changed_merchants"))


def distinct_merchants(pairs: DataFrame, group: Column) -> DataFrame:
    """Distinct merchants, and those with changed rows, of each group of months, exactly."""
    by = pairs.groupBy(group.alias("months"), "merchant").agg(F.sum("changed_rows").alias("changed"))
    return by.groupBy("months").agg(F.count("merchant").alias("merchants"), F.count_if(F.col("merchant").isNotNull() & (F.col("changed") > 0)).alias("changed_merchants"))


def estimated_merchants(sketches: DataFrame, group: Column) -> DataFrame:
    """The same from sketches, by estimate: reads a row a month, whatever the number of merchants."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("merchants", "changed_merchants")]
    return sketches.groupBy(group.alias("months")).agg(*merged)
