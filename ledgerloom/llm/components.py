"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import delete_shared, shared_path, written_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    linked = down.join(least, F.col("u") == F.col("w")).select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge that isn't its component's smallest node.

    edges: columns u and v, of the same type, without self links. Each round's edges
    are written to the shared folder, those of the round before deleted, and the rounds end
    when the edges stay the same, after about the logarithm of the largest component's size.
    """
    spark = edges.sparkSession
    path = shared_path(spark, "edges")
    now = written_at(edges.select("u", "v").distinct(), path)
    mark = None
    for _ in range(rounds):
        before, path = path, shared_path(spark, "edges")
        now = written_at(_small_star(_large_star(now)), path)
        delete_shared(spark, before)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if mark == tuple(seen):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
    raise RuntimeError("components did not settle")
