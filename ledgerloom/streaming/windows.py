"""Streaming sums of an event table, as an addition to the ledger's batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import js_round


def windowed(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and value in cents by type and tumbling window, of a batch or a stream."""
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.expr(js_round("(value * 100)"))).cast("long").alias("value_cents"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "value_cents")


def stream(spark: SparkSession, folder: str, schema, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """The same over Parquet files as they arrive; rows later than `late` are dropped."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(events.withWatermark("ts", late), width)


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """A row for each user's run of events of which none is more than the gap after the one before, of a batch or a stream."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.expr(js_round("(value * 100)"))).cast("long").alias("value_cents"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "value_cents")


def once(stream_: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """A stream's events without repeats that arrive within the watermark; keys are forgotten behind it."""
    return stream_.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def monthly(events: DataFrame) -> DataFrame:
    """Events and value in cents by month and type."""
    month = F.year("ts") * 12 + F.month("ts") - 1
    return events.groupBy(month.alias("month_idx"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.expr(js_round("(value * 100)"))).cast("long").alias("value_cents"))


def keep_monthly(stream_: DataFrame, path: str, checkpoint: str):
    """Start adding a stream's monthly totals to those kept at a path.

    Each micro-batch writes its sums under its own number, so a batch that runs again
    after a failure replaces what it wrote and nothing counts twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        monthly(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream_.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def kept_monthly(spark: SparkSession, path: str) -> DataFrame:
    """The totals that `keep_monthly` has kept, over all batches."""
    return spark.read.parquet(path).groupBy("month_idx", "event_type").agg(F.sum("events").alias("events"), F.sum("value_cents").cast("long").alias("value_cents"))
