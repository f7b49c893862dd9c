"""One document of each group of near copies: MinHash candidates, verified exactly.

Two texts are near copies if the Jaccard similarity of their sets of shingles (so many
words in a row, A to Z in lower case) reaches a bound.

Candidates are documents whose SimHash fingerprints are linked: those within three bits are found by multi-index
tables, as `simhash` does, and their components are groups of candidates. At 0.8 many pairs differ in
four to fourteen bits, and tables of so wide a radius have keys so short that the candidates grow with the
square of the documents. So documents that agree in one of 32 bands of six minima are groups of
candidates as well. A pair at 0.8 has no band in common with probability (1 - 0.8^6)^32 = 6e-5, one above it with less. Each pair
counts only if the similarity of its shingles, compared as they are, reaches the bound.

A group's documents are first compared with one of them alone, the one that shares most groups
with others, so likely what the others were copied from. Where a group's documents aren't
in one component then, they are joined by their rarest shingles: two sets at the bound
share one among the first (1 - bound) of each, in order of how many documents have them,
and what stands before it limits their overlap. So documents that are alike below the bound
give few pairs, however large their group; and no pair at the bound is lost or capped.

Cases: null text counts as empty; texts without words are copies of each other and of no
other text; one with fewer words than a shingle is one shingle. A null id is never the
smallest. Repeated rows leave one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_names, text_of, written
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import SEED, links, majority
from ledgerloom.llm.tokens import slices

BANDS, ROWS = 32, 6
_BLOCK = 1024
_random = np.random.default_rng(42)
_XOR = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A to Z only, and the six ASCII spaces


def _shingles(own: list[bytes], words: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else iter([b" ".join(own)])


def _hashes(own: list[bytes], words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, _shingles(own, words), repeat(SEED)), np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """The keys of the bands of shingles' hashes."""
    from xxhash import xxh64_intdigest

    hashes = np.unique(hashes)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for s in range(0, len(hashes), _BLOCK):
        np.minimum(least, ((hashes[s : s + _BLOCK] ^ _XOR) * _ODD).min(axis=1), out=least)
    keys = [xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def similarity(a: bytes, b: bytes, words: int) -> float:
    """The Jaccard similarity of two texts' sets of shingles."""
    x, y = set(_shingles(_words(a), words)), set(_shingles(_words(b), words))
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, print, text) as doc_id, print, digest of the words, SimHash fingerprint and bands."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for s in slices(batch):
                same, marks, keys = [], [], []
                for t in s.column("text").cast(pa.binary()).to_pylist():
                    own = _words(t)
                    same.append(xxh3_128_digest(b" ".join(own)))
                    hashes = _hashes(own, words)
                    marks.append(majority(hashes) if own else 0)
                    keys.append(bands(hashes))
                ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
                listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("print"), pa.array(same, pa.binary()), pa.array(np.array(marks, np.uint64).view(np.int64)), listed], names=["doc_id", "print", "same", "fp", "bands"])

    return rows.mapInArrow(add, "doc_id long, print long, same binary, fp long, bands array<long>")


def _linked(nodes: DataFrame) -> DataFrame:
    """(node, key): nodes of one component of fingerprints within three bits have the same key."""
    prints = written(nodes.select("fp").distinct(), "prints")
    roots = components(links(prints)).select(F.col("node").alias("__fp"), F.col("root").alias("__root"))
    placed = nodes.select("node", "fp").join(roots, F.col("fp") == F.col("__fp"), "left")
    return placed.select("node", F.xxhash64(F.lit("fingerprints"), F.coalesce("__root", "fp")).alias("key"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, bound: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts reach the bound."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("a").cast(pa.binary()), batch.column("b").cast(pa.binary()), strict=True)
            good = pa.array([similarity(a.as_py(), b.as_py(), words) >= bound for a, b in both], pa.bool_())
            yield batch.select(["u", "v"]).filter(good)

    one = texts.select(F.col("node").alias("__u"), F.col("text").alias("a"))
    other = texts.select(F.col("node").alias("__v"), F.col("text").alias("b"))
    joined = pairs.join(one, F.col("u") == F.col("__u")).join(other, F.col("v") == F.col("__v"))
    return joined.select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def _shingle_rows(nodes: DataFrame, words: int) -> DataFrame:
    """Rows (node, root, text) as (node, root, n, h): a row for each different shingle's hash."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for s in slices(batch):
                own = [np.unique(np.fromiter(map(xxh64_intdigest, _shingles(_words(t), words), repeat(SEED)), np.uint64)) for t in s.column("text").cast(pa.binary()).to_pylist()]
                n = np.array([len(h) for h in own], np.int64)
                row = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([s.column("node").take(row), s.column("root").take(row), pa.array(np.repeat(n, n)), pa.array(np.concatenate(own).view(np.int64))], names=["node", "root", "n", "h"])

    return nodes.mapInArrow(add, "node long, root long, n long, h long")


def _rare_pairs(nodes: DataFrame, words: int, bound: float) -> DataFrame:
    """(u, v) of nodes of different roots whose shingles may reach the bound, by their rarest ones.

    Hashes stand for shingles; where two agree by chance, a pair more is verified.
    """
    rows = written(_shingle_rows(nodes, words), "shingles")
    seen = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("h").alias("__h"), "c")
    ranked = rows.join(seen, F.col("h") == F.col("__h"), "left").withColumn("c", F.coalesce("c", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "h")) - 1
    # a hair below the bound, so that rounding can't cut a pair off
    t = bound - 1e-9
    first = ranked.withColumn("i", place).filter((F.col("i") <= F.col("n") - F.ceil(F.col("n") * t)) & (F.col("c") > 1))
    first = written(first.select("node", "root", "n", "h", "i"), "rare-shingles")
    a = first.select("h", F.col("node").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"), F.col("i").alias("iu"))
    b = first.select(F.col("h").alias("__h"), F.col("node").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("i").alias("iv"))
    apart = (F.col("h") == F.col("__h")) & (F.col("ru") < F.col("rv"))
    alike = (F.least("nu", "nv") >= F.greatest("nu", "nv") * t) & (F.least(F.col("nu") - F.col("iu"), F.col("nv") - F.col("iv")) >= (F.col("nu") + F.col("nv")) * (t / (1 + t)))
    return a.join(b, apart & alike).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _roots(shared: DataFrame, texts: DataFrame, words: int, bound: float) -> DataFrame:
    """(node, root) of the nodes that are not their component's smallest; shared: key, node and the key's first node."""
    stars = shared.filter("node != first").select(F.least("first", "node").alias("u"), F.greatest("first", "node").alias("v")).distinct()
    near = written(_verified(stars, texts, words, bound), "near-stars")
    roots = written(components(near), "star-roots").withColumnRenamed("node", "__n")
    placed = shared.select("key", "node").join(roots, F.col("node") == F.col("__n"), "left")
    placed = written(placed.select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select(F.col("key").alias("__key"))
    left = placed.join(mixed, F.col("key") == F.col("__key"), "left_semi").select(F.col("node").alias("__n"), "root").distinct()
    nodes = texts.join(left, F.col("node") == F.col("__n")).select("node", "root", "text")
    return components(near.union(_verified(_rare_pairs(nodes, words, bound), texts, words, bound)))


def drop_near_copies(df: DataFrame, words: int = 5, bound: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, with all their columns, with one row of each component of near copies: that of the smallest id."""
    print_of = F.xxhash64(text_of(text_col))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), print_of.alias("print"), text_of(text_col).alias("text"))
    prints = written(_prints(rows, words), "bands")
    # of rows with the same words that of the smallest id stands for all; null ids last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("print"))).alias("f")
    nodes = prints.groupBy("same").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands")).select("f.*", "fp", "bands")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key")).union(_linked(nodes))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("key").alias("__key"), "size")
    agreed = written(keys.join(several, F.col("key") == F.col("__key")).select("key", "node", "size"), "agreed")
    # of a group's documents the first is the one that agrees most often with others
    fame = agreed.groupBy("node").agg(F.sum("size").alias("fame")).select(F.col("node").alias("__n"), "fame")
    firsts = agreed.join(fame, F.col("node") == F.col("__n")).groupBy("key").agg(F.max(F.struct("fame", "node")).alias("f")).select(F.col("key").alias("__key"), F.col("f.node").alias("first"))
    shared = written(agreed.join(firsts, F.col("key") == F.col("__key")).select("key", "node", "first"), "shared")
    compared = nodes.join(shared.select(F.col("node").alias("__n")).distinct(), F.col("node") == F.col("__n"))
    own = rows.join(compared.select("node", F.col("id").alias("__id"), F.col("print").alias("__print")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")))
    texts = written(own.select("node", "text").dropDuplicates(["node"]), "compared")
    roots = _roots(shared, texts, words, bound).withColumnRenamed("node", "__n")
    placed = nodes.join(roots, F.col("node") == F.col("__n"), "left").select("z", "id", "print", "node", F.coalesce("root", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min(F.struct("z", "id", "node", "print")).alias("f"))
    a, b, c, k = free_names(df, "__null", "__id", "__print", "__k")
    kept = best.select(F.col("f.z").alias("z"), F.coalesce("f.id", F.lit(0)).alias("id"), F.col("f.print").alias("print"))
    keyed = df.withColumns({a: F.col(id_col).isNull(), b: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), c: print_of})
    joined = keyed.join(kept, (F.col(a) == kept.z) & (F.col(b) == kept.id) & (F.col(c) == kept.print), "left_semi")
    # repeated rows agree in all three
    alone = F.row_number().over(Window.partitionBy(a, b, c).orderBy(a))
    return joined.withColumn(k, alone).filter(F.col(k) == 1).select(*df.columns)
