"""Exact duplicates by content sort.

Rows are range-partitioned and sorted by (first characters of the normalised text, a
64-bit hash of it, longest original first, smallest id). Spark samples the splitters and
sorts externally; the sampled keys are of bounded size, whatever the texts. Equal texts
then stand next to each other, and one pass per partition compares each normalised text
in full with its neighbours of the same hash. Since length and id belong to the sort
key, a group with a third of all rows is split over many partitions; only the groups of
a partition's first and last hash can go on in another one, and those few are united by
their whole normalised texts. So nothing rests on a digest.

Cases: null text counts as empty; all empty texts form one group. A null id sorts
after every other id. Of fully repeated rows exactly one is kept. An empty table
gives an empty result. Other columns are ignored by `exact_duplicates` and carried
along by `drop_exact_duplicates`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import free_names, partitions, text_of, with_fields, written
from ledgerloom.llm.tokens import slices

#: The characters that normalisation deletes.
SPACES = " \t\n\x0b\x0c\r"
_DELETE = SPACES.encode()
#: Characters of the normalised text in the sort key.
HEAD = 32
_ROWS, _BYTES = 5000, 4_000_000


def normalised(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def _sorted(df: DataFrame, norm: Column, hash_name: str, n: Column, doc: Column) -> DataFrame:
    """Rows in content order, with the normalised text's hash."""
    head, size, own = free_names(df, "__start", "__n", "__id")
    keyed = df.withColumns({head: F.substring(norm, 1, HEAD), hash_name: _hash(norm), size: n, own: doc})
    order = [F.col(head), F.col(hash_name), F.col(size).desc(), F.col(own).asc_nulls_last()]
    return keyed.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).select(*df.columns, hash_name)


@dataclass
class _Group:
    norm: bytes
    ids: list
    first: pa.RecordBatch
    edge: bool = False


def _groups(batches: Iterator[pa.RecordBatch], hash_name: str, text: str, doc: str) -> Iterator[_Group]:
    """The partition's groups in order; of each the normalised text, all ids, and its first row."""

    def runs() -> Iterator[list[_Group]]:
        now, found = None, {}
        for batch in batches:
            for rows in slices(batch, text):
                texts = rows.column(text).cast(pa.binary()).to_pylist()
                for i, (h, own, t) in enumerate(zip(rows.column(hash_name).to_pylist(), rows.column(doc).to_pylist(), texts, strict=True)):
                    if h != now:
                        if found:
                            yield list(found.values())
                        now, found = h, {}
                    norm = (t or b"").translate(None, _DELETE)
                    if norm in found:
                        found[norm].ids.append(own)
                    else:
                        found[norm] = _Group(norm, [own], rows.slice(i, 1))
        if found:
            yield list(found.values())

    held, first = None, True
    for run in runs():
        if held:
            yield from held
        for g in run:
            g.edge = first
        held, first = run, False
    for g in held or ():
        g.edge = True
        yield g


_REPORT = "doc_id long, keep_id long, group_size long, text_sha256 string, part int, number long, head boolean, edge boolean, norm binary"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each input row, with its group's first id and size in this partition."""
    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _REPORT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = []
    for number, g in enumerate(_groups(batches, "h", "text", "doc_id")):
        sha = hashlib.sha256(g.norm).hexdigest()
        for i, own in enumerate(g.ids):
            rows.append((own, g.ids[0], len(g.ids), sha, part, number, i == 0, g.edge, g.norm if g.edge and i == 0 else None))
            if len(rows) >= _ROWS:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without spaces; of equal texts the longest
    original, then the smallest id, is kept.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_of(text_col)).alias("text"), F.length(text_of(text_col)).alias("n"))
    ordered = _sorted(narrow, F.col("text"), "h", F.col("n"), F.col("doc_id"))
    rows = written(ordered.select("doc_id", "text", "h").mapInArrow(_report, _REPORT), "content-sort")
    # the first groups and the last ones of the partitions, joined over their texts
    alike = Window.partitionBy("norm")
    edges = rows.filter("edge AND head").select(
        F.col("part").alias("__part"),
        F.col("number").alias("__number"),
        F.min_by("keep_id", "part").over(alike).alias("__keep"),
        F.sum("group_size").over(alike).alias("__size"),
        F.min("part").over(alike).alias("__first"),
    )
    at_edges = rows.filter("edge").join(edges, (F.col("part") == F.col("__part")) & (F.col("number") == F.col("__number")))
    united = at_edges.select("doc_id", F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("head") & (F.col("part") == F.col("__first"))).alias("kept"), "text_sha256")
    inside = rows.filter("NOT edge").select("doc_id", "keep_id", "group_size", F.col("head").alias("kept"), "text_sha256")
    return inside.unionByName(united)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, with all their columns, without all but one of equal texts."""
    hash_name, edge, part, norm = free_names(df, "__hash", "__edge", "__part", "__norm")
    ordered = _sorted(df, normalised(text_of(text_col)), hash_name, F.length(text_of(text_col)), F.col(id_col).cast("long"))
    names = df.columns
    at, own = names.index(text_col), names.index(id_col)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each group in this partition."""
        number = TaskContext.get().partitionId()
        plain = (pa.RecordBatch.from_arrays(b.columns, names=[str(i) for i in range(b.num_columns)]) for b in batches)
        some, edges, norms, size = [], [], [], 0

        def joined() -> pa.RecordBatch:
            whole = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            columns = whole.columns[: len(names)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(edges), pa.array([number] * len(some), pa.int32()), pa.array(norms, pa.binary())], names=[*names, edge, part, norm])

        for g in _groups(plain, str(len(names)), str(at), str(own)):
            some.append(g.first)
            edges.append(g.edge)
            norms.append(g.norm if g.edge else None)
            size += len(g.norm)
            if len(some) >= _ROWS or size >= _BYTES:
                yield joined()
                some, edges, norms, size = [], [], [], 0
        if some:
            yield joined()

    rows = written(ordered.mapInArrow(heads, with_fields(df.schema, (edge, T.BooleanType()), (part, T.IntegerType()), (norm, T.BinaryType()))), "content-heads")
    (first,) = free_names(rows, "__first")
    at_edges = rows.filter(F.col(edge)).withColumn(first, F.min(part).over(Window.partitionBy(norm))).filter(F.col(part) == F.col(first))
    return rows.filter(~F.col(edge)).select(*names).unionByName(at_edges.select(*names))
