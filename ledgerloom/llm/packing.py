"""Best-fit packing of documents into sequences, by large-item matching.

Every document is tokenised once, where it is read, and cut into pieces of at most the
capacity. How many pieces there are of each length, at most as many rows as the
capacity, is all that the plan needs: pieces above a third of the capacity are matched
greedily, the longest with the longest that fits, at most two in a sequence; the rest,
longest first, go where they leave the smallest gap. The plan works on runs of
sequences that hold the same lengths, so it stays of bounded size for any number of
documents. Pieces of one length are interchangeable: each is numbered within its
length, and the number gives its sequence and place. The task that cuts a piece numbers it
among its own pieces of that length; prefix sums of the tasks' counts shift these numbers.
They are written as a small array for each task, mapped where its pieces are read, so no
piece is sorted or shuffled. The ids stay with their piece: a sequence's tokens are the
`ids` of its pieces, in order of offset.

Cases: null text counts as empty; every document has at least its end id, so nothing is
left out. Repeated rows are packed each. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared_path, text_of, written
from ledgerloom.llm.stores import mapped, save, store_of
from ledgerloom.llm.tokens import slices, tokenizer

#: A run of sequences with the same content: how many, and ((length, times), ...) in order.
Run = tuple[int, tuple[tuple[int, int], ...]]


class _Gaps:
    """Runs by the room left in their sequences."""

    def __init__(self):
        self._by: dict[int, list[list]] = {}
        self._sorted: list[int] = []

    def add(self, gap: int, n: int, content: tuple) -> None:
        if n:
            if gap not in self._by:
                insort(self._sorted, gap)
            self._by.setdefault(gap, []).append([n, content])

    def take(self, length: int) -> tuple[int, int, tuple] | None:
        """The run with the smallest room that is enough: (room, sequences, content)."""
        k = bisect_left(self._sorted, length)
        if k == len(self._sorted):
            return None
        gap = self._sorted[k]
        n, content = self._by[gap].pop()
        if not self._by[gap]:
            del self._by[gap], self._sorted[k]
        return gap, n, content

    def runs(self) -> list[Run]:
        return [(n, content) for gap in self._sorted for n, content in self._by[gap]]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """The runs of sequences that hold `counts[length]` pieces of each length."""
    left = {k: n for k, n in sorted(counts.items(), reverse=True) if n > 0}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError("lengths must be from 1 to the capacity")
    gaps = _Gaps()
    large = [k for k in left if 3 * k > capacity]
    small = [k for k in left if 3 * k <= capacity]
    rising = large[::-1]
    for k in large:  # the longest piece with the longest that fits beside it
        while left[k]:
            at = bisect_left(rising, capacity - k + 1) - 1
            while at >= 0 and not left[rising[at]]:
                del rising[at]
                at -= 1
            mate = rising[at] if at >= 0 else 0
            if not mate or mate == k and left[k] == 1:
                if mate and at:  # a single one of this length: the next shorter one
                    mate = next((m for m in reversed(rising[:at]) if left[m]), 0)
                else:
                    mate = 0
            if not mate:
                gaps.add(capacity - k, left[k], ((k, 1),))
                left[k] = 0
            elif mate == k:
                gaps.add(capacity - 2 * k, left[k] // 2, ((k, 2),))
                left[k] %= 2
            else:
                n = min(left[k], left[mate])
                gaps.add(capacity - k - mate, n, ((k, 1), (mate, 1)))
                left[k] -= n
                left[mate] -= n
    for k in small:  # into the smallest gaps, each filled before the next
        n = left[k]
        while n:
            gap, sequences, content = gaps.take(k) or (capacity, -(-n // (capacity // k)), ())
            times = gap // k
            full = min(sequences, n // times)
            gaps.add(gap - times * k, full, (*content, (k, times)))
            n -= full * times
            rest = sequences - full
            if rest and n:  # fewer than would fit in one more
                gaps.add(gap - n * k, 1, (*content, (k, n)))
                n, rest = 0, rest - 1
            gaps.add(gap, rest, content)
    return gaps.runs()


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """For pieces of a length, by number: from which one on they lie in which run, and where."""
    rows, seen, base = [], {}, 0
    for n, content in runs:
        offset = 0
        for length, times in content:
            first = seen.get(length, 0)
            rows.append((length, first, base, times, offset))
            seen[length] = first + n * times
            offset += length * times
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "times", "offset"), table.T, strict=True))


def _key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
    return length.astype(np.int64) << 44 | number.astype(np.int64)


def pieces(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids (little-endian, of 32 bits), task and number.

    `number` counts from 0 within the task and length; it holds only for one run of the
    tasks, so it is to be written before it is used.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch):
                tokens, at = coder.encode(rows.column("text"))
                tokens = np.insert(tokens.astype("<u4"), at[1:], end_id)
                ends = at[1:] + np.arange(1, len(at))
                begins = np.concatenate([[0], ends[:-1]])
                n = -(-(ends - begins) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                a = begins[row] + start
                length = np.minimum(a + capacity, ends[row]) - a
                order = np.argsort(length, kind="stable")
                in_order = length[order]
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(length)) - np.searchsorted(in_order, in_order) + seen[in_order]
                seen += np.bincount(length, minlength=capacity + 1)
                bounds = pa.array(np.append(4 * a, 4 * len(tokens)).astype(np.int32))
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, bounds.buffers()[1], pa.py_buffer(tokens)])
                columns = [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids, pa.array(np.full(len(row), task, np.int32)), pa.array(number)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "task", "number"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, task int, number long")


def _bases(each: DataFrame, capacity: int) -> str:
    """Write, for each task, how many pieces of each length the tasks before it have; returns the folder."""
    spark = each.sparkSession
    path = shared_path(spark, "piece-bases")
    store, root = store_of(path)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, rows in zip(batch.column("task").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                bases = np.zeros(capacity + 1, "<i8")
                for r in rows:
                    bases[r["length"]] = r["base"]
                save(f"{path}/base-{task}", bases)
            yield pa.RecordBatch.from_pydict({"tasks": [batch.num_rows]})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select("task", F.struct("length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).alias("r"))
    # a list of at most `capacity` for each task
    bases.groupBy("task").agg(F.collect_list("r").alias("rows")).mapInArrow(write, "tasks long").agg(F.sum("tasks")).first()
    return path


def sequences(df: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """All pieces, with their ids (little-endian 32-bit integers), their sequence and their offset in it."""
    cut = written(pieces(df, tokenizer_path, end_id, capacity), "pieces")
    each = written(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    keys = _key(table["length"], table["first"])

    path = _bases(each, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(task: pd.Series, length: pd.Series, number: pd.Series) -> pd.DataFrame:
        task, length, number = (x.to_numpy(np.int64) for x in (task, length, number))
        number = number.copy()
        for t in np.unique(task).tolist():
            own = task == t
            number[own] += mapped(f"{path}/base-{t}", "<i8")[length[own]]
        at = np.searchsorted(keys, _key(length, number), side="right") - 1
        ahead, times = number - table["first"][at], table["times"][at]
        return pd.DataFrame({"sequence_id": table["sequence"][at] + ahead // times, "offset": table["offset"][at] + ahead % times * length})

    placed = cut.select("doc_id", "piece", "start", "length", "ids", place("task", "length", "number").alias("p"))
    return placed.select("doc_id", "piece", "start", "length", "ids", "p.sequence_id", "p.offset")


def packed(df: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """All pieces with their sequence and offset in it, and digests of their ids."""
    return sequences(df, tokenizer_path, end_id, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
