"""Flat binary arrays in a shared folder, mapped into memory by the tasks that read them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.fs as pafs


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def save(path: str, array: np.ndarray) -> None:
    """Write under a name of its own, then rename: a task that runs again leaves the same file."""
    store, name = store_of(path)
    own = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B"))
    store.move(own, name)


#: What a worker holds of files that can't be mapped, in bytes; the oldest go first.
HELD = 256 << 20
_held: dict[str, bytes] = {}


def _read(store: pafs.FileSystem, path: str, name: str) -> bytes:
    if path not in _held:
        data = store.open_input_stream(name).read()
        while _held and sum(map(len, _held.values())) + len(data) > HELD:
            del _held[next(iter(_held))]
        _held[path] = data
    return _held[path]


def mapped(path: str, dtype: str) -> np.ndarray:
    """The array in a file, never changed once written: mapped where the store has files to map, else read and held."""
    store, name = store_of(path)
    if isinstance(store, pafs.LocalFileSystem):
        return np.asarray(np.memmap(name, dtype, "r")) if store.get_file_info(name).size else np.empty(0, dtype)
    return np.frombuffer(_read(store, path, name), dtype)


def save_counts(path: str, counts: np.ndarray) -> None:
    """Counts in 32 bits each, or in 64 where one needs them."""
    save(path, counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8"))


def mapped_counts(path: str, n: int) -> np.ndarray:
    """The n counts in a file, of either width."""
    data = mapped(path, "u1")
    return data.view("<u4" if len(data) == 4 * n else "<u8")
