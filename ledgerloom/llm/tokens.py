"""Token ids of whole texts with a public tokenizer file, by chunks that repeat.

Both vocabularies used here cut a text at white space before they merge, so a text's
ids are those of its chunks in turn, and a chunk that was met before need not be
merged again. The cuts are only made where they are exact:

* "gap": before a single space between two characters that aren't white space, which
  a byte-level pattern always cuts (the space belongs to the word after it);
* "blank": at spaces and line feeds, which a pattern that drops white space ignores.

Texts are cut, and their chunks told apart, in Arrow. New chunks go through the
tokenizers library many at a time, joined to one text whose ids are cut again: under
"gap" at the tokens that begin with a space, under "blank" at a number sign put between
them, which is always a token of its own. A bounded number of chunks and their ids stay
in Arrow arrays; the others are merged again whenever a slice has them.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WHITE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]"
_WIDE = f"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$"
_ODD = f" |^{_WHITE}|{_WHITE}$"
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Chunks whose ids are kept; later ones are merged again in every slice that has them.
KEPT = 450_000
#: Number signs that may stand between joined chunks; the first that is one token is taken.
_MARKS = "½²³7"
_JOINED = 512
_BATCH = 32 * _JOINED


class ChunkTokenizer:
    """Ids of columns of texts, as arrays of `dtype`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.cut = _cut_rule(path)
        self._kept = pa.array([], pa.large_string())
        self._ids = self._lists(np.empty(0, self.dtype), np.empty(0, np.int64))
        self._mark, self._begins = "", np.zeros(self.vocabulary, bool)
        if self.cut == "blank":
            ids = {m: self._tokenizer.encode(m, add_special_tokens=False).ids for m in _MARKS}
            self._mark = next((m for m in _MARKS if len(ids[m]) == 1), "")
            self._begins[ids[self._mark] if self._mark else []] = True
        elif self.cut == "gap":
            self._begins[[i for t, i in self._tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True

    def _lists(self, flat: np.ndarray, lengths: np.ndarray) -> pa.LargeListArray:
        return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), flat)

    def _single(self, chunks: list[str]) -> pa.LargeListArray:
        """The ids of chunks, each for itself."""
        found = [e.ids for e in self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return self._lists(np.fromiter((i for x in found for i in x), self.dtype, lengths.sum()), lengths)

    def _merged(self, chunks: pa.Array) -> pa.LargeListArray:
        """The ids of new chunks; under "gap" each with a space before it."""
        if self.cut == "gap":
            odd, before, between, after = pc.match_substring_regex(chunks, _ODD), " ", " ", ""
        elif self._mark:
            odd, before, between, after = pc.match_substring(chunks, self._mark), "", f" {self._mark} ", f" {self._mark}"
        else:
            return self._batches(chunks.to_pylist())
        odd = pc.or_(odd, pc.equal(chunks, ""))
        plain = chunks.filter(pc.invert(odd)).to_pylist()
        parts = []
        for s in range(0, len(plain), _BATCH):
            runs = [plain[i : i + _JOINED] for i in range(s, min(len(plain), s + _BATCH), _JOINED)]
            coded = self._tokenizer.encode_batch_fast([before + between.join(r) + after for r in runs], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in coded])
            spots = np.flatnonzero(self._begins[ids])
            if len(spots) != sum(map(len, runs)):
                raise ValueError(f"joined chunks of a {self.cut} vocabulary can't be told apart")
            if self.cut == "gap":
                parts.append(self._lists(ids, np.diff(spots, append=len(ids))))
            else:
                parts.append(self._lists(np.delete(ids, spots), np.diff(spots, prepend=-1) - 1))
        strange = [before + c for c in chunks.filter(odd).to_pylist()]
        both = pa.concat_arrays([*parts, self._batches(strange)])
        order = np.argsort(np.asarray(odd.to_numpy(zero_copy_only=False), bool), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return both.take(pa.array(place))

    def _batches(self, chunks: list[str]) -> pa.LargeListArray:
        parts = [self._single(chunks[s : s + _BATCH]) for s in range(0, len(chunks), _BATCH)]
        return pa.concat_arrays(parts) if parts else self._ids[:0]

    def _looked_up(self, chunks: pa.Array) -> tuple[pa.LargeListArray, np.ndarray]:
        """Lists of ids, and where each of the different chunks has its own."""
        at = pc.index_in(chunks, value_set=self._kept)
        unknown = at.is_null()
        new = chunks.filter(unknown)
        fresh = self._merged(new)
        lists, base = pa.concat_arrays([self._ids, fresh]), len(self._ids)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[unknown.to_numpy(zero_copy_only=False)] = base + np.arange(len(new))
        if base < KEPT:
            self._kept = pa.concat_arrays([self._kept, new[: KEPT - base]])
            self._ids = pa.concat_arrays([self._ids, fresh[: KEPT - base]])
        return lists, place

    def _cut_texts(self, texts: pa.Array) -> pa.LargeListArray:
        """Each text's chunks; under "gap" all but the first lack the space before them."""
        if self.cut == "blank":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        if self.cut == "whole":
            return pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), texts)
        wide = pc.match_substring_regex(texts, _WIDE)
        if not pc.any(wide).as_py():
            return pc.split_pattern(texts, " ")
        rows = [_GAP.split(t) if w else t.split(" ") for t, w in zip(texts.to_pylist(), wide.to_pylist(), strict=True)]
        return pa.array(rows, pa.large_list(pa.large_string()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's start (with the end)."""
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        cut = self._cut_texts(texts.cast(pa.large_string()))
        at = np.asarray(cut.offsets, np.int64)
        coded = cut.flatten().dictionary_encode()
        codes, chunks = np.asarray(coded.indices), coded.dictionary
        if self.cut == "gap":  # the texts' first chunks have no space before them
            rest = np.ones(len(codes), bool)
            rest[at[:-1]] = False
            used = np.zeros(len(chunks), bool)
            used[codes[rest]] = True
            number = np.cumsum(used) - 1
            lists, place = self._looked_up(chunks.filter(pa.array(used)))
            firsts, where = np.unique(codes[~rest], return_inverse=True)
            lists, base = pa.concat_arrays([lists, self._batches(chunks.take(pa.array(firsts)).to_pylist())]), len(lists)
            index = np.empty(len(codes), np.int64)
            index[rest] = place[number[codes[rest]]]
            index[~rest] = base + where
        else:
            lists, place = self._looked_up(chunks)
            index = place[codes]
        ids = lists.take(pa.array(index))
        return ids.values.to_numpy(), np.asarray(ids.offsets, np.int64)[at]


def _cut_rule(path: str) -> str:
    """Which cuts are exact for a tokenizer file; "whole" if it isn't of a known kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None:
        return "gap"
    split = (before.get("pretokenizers") or [{}])[0]
    if split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert"):
        pattern = split.get("pattern", {}).get("Regex", "")
        if pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            return "blank"
    return "whole"


_open: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer for a file, opened once."""
    if path not in _open:
        _open[path] = ChunkTokenizer(path)
    return _open[path]


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks, and shares the executor's memory."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", characters: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, each of one row at least."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + characters, side="right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()
