"""Sharding by a hierarchical weighted hash tree.

A row descends from region to rack to shard. At each level every child draws
-ln(u) / weight, with u hashed from (key, child), and the smallest draw wins, so a
child gets rows in proportion to its weight. A child's draw doesn't depend on its
siblings: when weights change, rows only move into subtrees whose weight rose or out
of subtrees whose weight fell, and all else stays. A shard added in a region of its
own (`Tree.grown`) thus takes rows from everywhere and only into itself.

Everything is DataFrame functions; the tree is a constant of bounded size.
Cases: a null key hashes like any other value; repeated rows share a shard and get
different slots; null text has no bytes; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_names, numbered


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shard weights; shards are numbered from left to right."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, shards: int, per_rack: int = 5, racks_per_region: int = 2) -> Tree:
        """Shards of equal weight; the last rack and region may be smaller."""
        if shards < 1:
            raise ValueError("a tree needs a shard")
        racks = [(1.0,) * min(per_rack, shards - i) for i in range(0, shards, per_rack)]
        return cls(tuple(tuple(racks[i : i + racks_per_region]) for i in range(0, len(racks), racks_per_region)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own."""
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _won(key: Column, prefix: list[Column], node: Column, weights: list[list[float]]) -> Column:
    """The child of the node that has the smallest draw, exponential with its weight as rate; ties go to the first.

    weights: of the children of every node of the level. The expression has a draw for each
    of as many children as the widest node has, however many nodes there are.
    """
    width = max(map(len, weights))
    flat = [float(w) for own in weights for w in [*own, *[0.0] * (width - len(own))]]
    table = F.array(*map(F.lit, flat))
    draws = []
    for j in range(width):
        name = F.concat_ws("/", *[c.cast("string") for c in prefix], F.lit(str(j)))
        bits = F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double")
        weight = F.element_at(table, (node * width + j + 1).cast("int"))
        draws.append(F.when(weight > 0, F.struct((-F.log((bits + 0.5) * F.lit(2.0**-53)) / weight).alias("d"), F.lit(j).alias("j"))))
    return F.array_min(F.array(*draws)).getField("j")


def _leveled(df: DataFrame, tree: Tree, key: Column, out: str) -> DataFrame:
    """Adds `out`; each level is a column, so a row draws only among its node's children."""
    region, rack, inside = free_names(df, "__region", "__rack", "__inside")
    racks = max(map(len, tree.regions))
    padded = [[*r, *[()] * (racks - len(r))] for r in tree.regions]
    df = df.withColumn(region, _won(key, [], F.lit(0), [[sum(map(sum, r)) for r in tree.regions]]))
    df = df.withColumn(rack, _won(key, [F.col(region)], F.col(region), [[sum(x) for x in r] for r in tree.regions]))
    node = F.col(region) * racks + F.col(rack)
    df = df.withColumn(inside, _won(key, [F.col(region), F.col(rack)], node, [list(x) for r in padded for x in r]))
    first, firsts = 0, []
    for r in padded:
        for x in r:
            firsts.append(first)
            first += len(x)
    number = F.element_at(F.array(*map(F.lit, firsts)), (node + 1).cast("int")) + F.col(inside)
    return df.withColumn(out, number).drop(region, rack, inside)


def assign_shards(df: DataFrame, tree: Tree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """The rows with the shard that their key descends to in the tree."""
    return _leveled(df, tree, F.col(key), out)


def sharded(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard plan of all rows: size, checksum, shard, slot in it, and the shard with one more.

    Only ids, sizes and checksums are shuffled, for the slots.
    """
    tree = Tree.even(shards)
    size = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8"))
    rows = df.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    rows = assign_shards(assign_shards(rows, tree), tree.grown(), out="grown_shard")
    rows = numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
