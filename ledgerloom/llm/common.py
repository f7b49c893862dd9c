"""What the text operators share: the shared folder, written tables, ranks without hot tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle makes in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own, which is
    removed at exit; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/ledgerloom-{uuid.uuid4().hex[:12]}-{name}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_shared(spark: SparkSession, path: str) -> None:
    """Delete what was written at a shared path, once nothing reads it any more."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written in the shared folder; cuts the lineage."""
    return written_at(df, shared_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: a gapless number from 0 for the rows of each key.

    Rows are dealt to salted buckets in the order in which they are read, whatever they hold, and
    written with their bucket; each key's buckets are numbered for themselves and shifted by the
    sizes of those before, so that neither a key with a third of all rows nor a third of equal rows is
    one task's work. The sizes are (keys x buckets) rows and are joined back by an ordinary
    shuffle or broadcast.
    """
    n = partitions(df.sparkSession)
    salted = written(df.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")), "salted")
    sizes = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    bases = bases.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__salt").alias("__s"), "__base")
    inside = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order))
    ranked = salted.withColumn("__rank", inside)
    same = F.col("__salt") == F.col("__s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = ranked.join(bases, same)
    return joined.select(*df.columns, (F.col("__base") + F.col("__rank") - 1).cast("long").alias(out))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of the table has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])
