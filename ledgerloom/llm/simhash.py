"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it.
Fingerprints of at most three differing bits are linked. Of two such fingerprints,
at least one half (32 bits) differs in one bit at most. So each fingerprint is entered
in a table under each of its halves, and for each half all 33 values within one bit, a
small Hamming ball, are looked up in that half's table; whatever is found is verified
on all 64 bits. No link is missed, and none is capped.

Copies share a fingerprint and are looked up once; the lookup is an equi-join of
(half, value), whose keys are as many as the fingerprints, and the links' components are
found by alternating stars. Documents get the smallest id of their component.

Cases: null text counts as empty; a text without words has fingerprint zero, linked
like any other; one with fewer words than a shingle is one shingle. A null id is never
the smallest; a component of null ids only has a null id. Repeated rows are reported
each. An empty table gives no rows; other columns are ignored by `near_duplicates` and
carried along by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import free_names, text_of, with_fields, written
from ledgerloom.llm.components import components
from ledgerloom.llm.tokens import slices

SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """The 64-bit SimHash of UTF-8 text over shingles of so many words, A to Z in lower case."""
    from xxhash import xxh64_intdigest

    own = text.lower().split()  # of bytes: A to Z only, and the six ASCII spaces
    if not own:
        return 0
    shingles = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    bits = np.zeros(64, np.int64)
    for s in range(0, len(hashes), _BLOCK):
        bits += np.unpackbits(hashes[s : s + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array, words: int) -> pa.Array:
    out = np.array([fingerprint(t, words) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
    return pa.array(out.view(np.int64))


def with_fingerprints(df: DataFrame, words: int, out: str, text_col: str = "text") -> DataFrame:
    """The rows with their fingerprint as a signed 64-bit integer."""
    at = df.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            found = [_fingerprints(s.column("text"), words) for s in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
            both = [*batch.columns, pa.concat_arrays(found) if found else pa.array([], pa.int64())]
            yield pa.RecordBatch.from_arrays(both, names=[*batch.schema.names, out])

    return df.mapInArrow(add, with_fields(df.schema, (out, T.LongType())))


def links(prints: DataFrame) -> DataFrame:
    """(u, v), u < v, for all different fingerprints of column fp within three bits, some twice."""
    half = F.posexplode(F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32))).alias("h", "x")
    halves = prints.select("fp", half)
    key = F.shiftleft(F.col("h").cast("long"), 32).bitwiseOR(F.col("x"))
    table = halves.select(key.alias("key"), F.col("fp").alias("v"))
    ball = F.explode(F.expr("concat(array(x), transform(sequence(0, 31), i -> x ^ shiftleft(1L, i)))")).alias("x")
    probes = halves.select("fp", "h", ball).select(key.alias("probe"), F.col("fp").alias("u"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 3)
    return probes.join(table, (F.col("probe") == F.col("key")) & near).select("u", "v")


def _classes(rows: DataFrame) -> DataFrame:
    """(print, component_id, first) for each fingerprint: its component's smallest id, and fingerprint with it."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "prints")
    roots = components(links(nodes))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    # the smallest id, its fingerprint breaking ties; null ids last
    first = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("fp"))).alias("f")
    best = placed.groupBy("root").agg(first).select(F.col("root").alias("__r"), F.col("f.id").alias("component_id"), F.col("f.fp").alias("first"))
    return placed.join(best, F.col("root") == F.col("__r")).select(F.col("fp").alias("print"), "component_id", "first")


def near_duplicates(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint in hex, component_id."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = written(with_fingerprints(rows, words, "fp").select("doc_id", "fp"), "fingerprints")
    joined = rows.join(_classes(rows), F.col("fp") == F.col("print"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, with all their columns, with one row of each component: that of the smallest id."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = written(with_fingerprints(rows, words, "fp").select("doc_id", "fp"), "fingerprints")
    kept = _classes(rows).filter("print = first").select(F.col("component_id").alias("__id"), F.col("print").alias("__print"))
    null, own, print_, k = free_names(df, "__null", "__id", "__fp", "__k")
    whole = with_fingerprints(df, words, print_, text_col).withColumns({null: F.col(id_col).isNull(), own: F.coalesce(F.col(id_col).cast("long"), F.lit(0))})
    best = kept.select(F.col("__id").isNull().alias("z"), F.coalesce("__id", F.lit(0)).alias("id"), F.col("__print").alias("print"))
    joined = whole.join(best, (F.col(null) == best.z) & (F.col(own) == best.id) & (F.col(print_) == best.print), "left_semi")
    # repeated rows agree in all three
    alone = F.row_number().over(Window.partitionBy(null, own, print_).orderBy(null))
    return joined.withColumn(k, alone).filter(F.col(k) == 1).select(*df.columns)
