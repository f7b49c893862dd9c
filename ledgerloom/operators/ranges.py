"""Positions in an order, found by counting ranges: no task sorts more than the ranges it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_range(amount: Column, parts: int = 64) -> Column:
    """A number that doesn't fall as an amount rises: ranges of a 64th of an octave by default, a few thousand in all."""
    size = F.floor(F.log2(F.abs(amount.cast("double")) + 1) * parts)
    return F.when(amount < 0, -size - 1).otherwise(size).cast("int")


def ranked(df: DataFrame, key: str, amount: str, then: str, out: str) -> DataFrame:
    """Adds `out`: each row's place from 1 in its key, largest amount first, then by another column.

    Rows are numbered within ranges of the amount, and a range's first place is the number of
    rows in the key's ranges above it. A key with a third of all rows thus spreads over its
    ranges; only rows of about the same amount are sorted together. The windows over ranges
    see a few thousand counts a key at most.
    """
    parted = df.withColumn("__part", log_range(F.col(amount)))
    sizes = parted.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy(key).orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col(key).alias("__key"), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(key, "__part").orderBy(F.col(amount).desc(), then))
    joined = parted.withColumn("__place", inside).join(bases, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return joined.select(*df.columns, (F.col("__base") + F.col("__place")).cast("int").alias(out))


def at_positions(df: DataFrame, order: list[Column], parts: list[tuple[Column, bool]], start: int, size: int, most: int = 100_000) -> DataFrame:
    """Rows `start` to `start + size` of the sorted rows.

    parts: coarse columns that follow the order, with whether they descend, from the widest ranges
    to the narrowest (a date, then ever longer beginnings of an id). The ranges of one are
    counted, and rows of those ranges alone that the positions fall in are read on; a range of
    more than `most` rows is looked into by the next. A count a range goes through one window.
    """
    if not parts:
        return df.orderBy(*order).offset(start).limit(size)
    (part, descends), *rest = parts
    counts = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    along = F.col("part").desc() if descends else F.col("part").asc()
    before = F.coalesce(F.sum("n").over(Window.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counts.select("part", "n", before.alias("before")).filter((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).orderBy("before").collect()  # each has a row of the page
    pieces = []
    for r in found:
        own = df.filter(part.eqNullSafe(F.lit(r.part)))
        first = max(0, start - r.before)
        take = min(size, start + size - r.before, r.n - first)
        pieces.append(at_positions(own, order, rest if r.n > most else [], first, take, most))
    if not pieces:
        return df.limit(0)
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order) if len(pieces) > 1 else out
