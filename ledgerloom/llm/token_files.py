"""Token ids of a corpus in flat binary files.

Documents are range-partitioned by id and sorted, so that part k holds no id above
those of part k + 1. Each task encodes its documents in order and appends the ids, as
unsigned integers of the narrowest fitting width, to one file, and writes beside it
the documents' ids and their 64-bit offsets in that file. The parts' sizes, a row for
each, give every part its base by prefix sums; they are written as a manifest. A
reader maps a part into memory; no file is read whole on the way to one document.

A task writes under a name of its own and renames at the end, so a task that runs
again, after an executor was lost, leaves the same files.

Cases: null text counts as empty, and a document without ids has its end id alone.
Null ids come first; rows with the same id follow each other in order of a hash of their text. An
empty table makes a manifest without parts. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import partitions, shared_path, text_of
from ledgerloom.llm.tokens import slices, tokenizer

NULL_ID = -(2**63)


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class Part:
    """One part: its documents' ids and offsets, and the token file, mapped where the store allows."""

    def __init__(self, path: str, number: int, dtype: str):
        fs, root = _fs(path)
        name = f"{root}/part-{number:06d}"
        if isinstance(fs, pa.fs.LocalFileSystem):
            index = np.memmap(f"{name}.idx", np.uint8, "r")
            size = fs.get_file_info(f"{name}.bin").size
            self.tokens = np.memmap(f"{name}.bin", dtype, "r") if size else np.empty(0, dtype)
        else:  # a store without files to map: the part is read
            index, self.tokens = (np.frombuffer(fs.open_input_stream(f"{name}.{x}").read(), t) for x, t in (("idx", np.uint8), ("bin", dtype)))
        n = (len(index) // 8 - 1) // 2
        self.ids = np.frombuffer(index[: 8 * n], "<i8")
        self.offsets = np.frombuffer(index[8 * n :], "<u8").astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.offsets[k] : self.offsets[k + 1]]


class TokenFiles:
    """All parts; document k in the order of ids, from 0."""

    def __init__(self, path: str):
        self.path = path
        fs, root = _fs(path)
        self.manifest = json.loads(fs.open_input_stream(f"{root}/manifest.json").read())
        self._docs = np.array([p["first_document"] for p in self.manifest["parts"]], np.int64)

    def __len__(self) -> int:
        return self.manifest["documents"]

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self._docs, k, side="right")) - 1
        part = self.manifest["parts"][at]
        return Part(self.path, part["part"], self.manifest["dtype"])[k - part["first_document"]]


def _writer(path: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, coder = TaskContext.get().partitionId(), tokenizer(tokenizer_path)
        fs, root = _fs(path)
        name, own = f"{root}/part-{number:06d}", f"{root}/_{uuid.uuid4().hex}"
        end = np.array([end_id], coder.dtype)
        ids, offsets, total = [], [np.zeros(1, np.int64)], 0
        with fs.open_output_stream(f"{own}.bin") as out:
            for batch in batches:
                for rows in slices(batch):
                    tokens, at = coder.encode(rows.column("text"))
                    out.write(np.insert(tokens, at[1:], end[0]).astype(coder.dtype, copy=False).tobytes())
                    ends = at[1:] + np.arange(1, len(at))
                    offsets.append(total + ends)
                    total += int(ends[-1]) if len(ends) else 0
                    ids.append(np.asarray(rows.column("doc_id").fill_null(NULL_ID), np.int64))
        if not ids:
            fs.delete_file(f"{own}.bin")
            return
        doc_ids = np.concatenate(ids)
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(doc_ids.astype("<i8").tobytes() + np.concatenate(offsets).astype("<u8").tobytes())
        for x in ("bin", "idx"):
            fs.move(f"{own}.{x}", f"{name}.{x}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "documents": [len(doc_ids)], "tokens": [total], "dtype": [coder.dtype.str]})

    return write


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode all documents, each with `end_id` after it, into files under `path`."""
    spark = df.sparkSession
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # rows that share an id, or have none, are split by a hash of their text
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    stats = rows.mapInArrow(_writer(path, tokenizer_path, end_id), "part int, documents long, tokens long, dtype string")
    parts, docs, tokens = [], 0, 0
    for r in sorted(stats.collect(), key=lambda r: r.part):  # a row for each part
        parts.append({"part": r.part, "documents": r.documents, "tokens": r.tokens, "first_document": docs, "base": tokens, "dtype": r.dtype})
        docs, tokens = docs + r.documents, tokens + r.tokens
    manifest = {"dtype": parts[0]["dtype"] if parts else "<u2", "end_id": end_id, "documents": docs, "tokens": tokens, "parts": parts}
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return TokenFiles(path)


def read_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Every document as read back: doc_id, start, n_tokens, ids_crc32."""
    path, dtype, parts = files.path, files.manifest["dtype"], files.manifest["parts"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                part = Part(path, number, dtype)
                for s in range(0, len(part), 20_000):
                    k = range(s, min(len(part), s + 20_000))
                    sums = [zlib.crc32(part[i].astype("<u4").tobytes()) for i in k]
                    ids = part.ids[s : k.stop]
                    at = part.offsets[s : k.stop + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(i, p["part"], p["base"]) for i, p in enumerate(parts)], "at int, part int, base long")
    if parts:  # a task for each part
        rows = rows.repartitionById(len(parts), F.col("at"))
    return rows.mapInArrow(read, schema)


def token_digests(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files in the shared folder and return each document as read from them."""
    path = shared_path(df.sparkSession, "token-files")
    return read_documents(df.sparkSession, write_token_files(df, path, tokenizer_path, end_id))
