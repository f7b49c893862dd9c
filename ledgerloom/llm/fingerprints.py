"""Document fingerprints from prefix polynomial hashes.

For a text c[0..n) the prefix array is H[i] = sum over j < i of (c[j] + 1) * B^j,
modulo two primes. The hash of any span is a difference of two entries shifted back
to position 0, so any two spans, of one text or of two, are compared in constant
time, and the longest common extension of two positions is found by binary search. The
arrays of a text put together from the beginnings of two others come from theirs.

A fingerprint keeps the text's length, its whole hash, 32-bit hashes of its first
and last k characters for k on a fixed ladder (four steps an octave), and anchors: the
smallest mixed hashes of all its spans of 24 characters. Prefixes that agree at one step
agree at all steps below, so the longest common prefix and suffix of two texts are
found by binary search on their ladders, to the next step. Anchors tell how many
spans two texts share wherever they stand. The likeness of two fingerprints is the
share of the longer text that prefix and suffix cover, or that shared spans make up,
whichever is more.

A ladder step agrees by chance with probability 2^-32; the anchors' share has a
standard error of at most 0.07.

Cases: null text counts as empty; two empty texts have likeness 1, an empty and another
one 0. Rows follow each other in order of id (nulls first), then of a hash of their text,
so that those which share an id are split over parts; repeated rows follow each other. A
single row follows itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import partitions, text_of
from ledgerloom.llm.tokens import slices

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
_INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True))
_BLOCK = 1 << 18
#: Characters of a span that may be an anchor, and how many anchors a fingerprint has at most.
SPAN, ANCHORS = 24, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _powers(base: int, prime: int) -> np.ndarray:
    """base^j for j within a block."""
    x = np.ones(1, np.uint64)
    while len(x) < _BLOCK:
        x = np.concatenate([x, x * np.uint64(pow(base, len(x), prime)) % np.uint64(prime)])
    return x


class PrefixHashes:
    """Modular prefix arrays of one text."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(c)
        self.arrays = []
        for base, p in zip(BASES, PRIMES, strict=True):
            h, powers = np.zeros(self.n + 1, np.uint32), _powers(base, p)
            carry = 0
            for s in range(0, self.n, _BLOCK):
                x = c[s : s + _BLOCK].astype(np.uint64)
                x += np.uint64(1)
                x *= powers[: len(x)]
                x %= np.uint64(p)
                np.cumsum(x, out=x)
                x %= np.uint64(p)
                if s:
                    x *= np.uint64(pow(base, s, p))
                    x += np.uint64(carry)
                    x %= np.uint64(p)
                h[s + 1 : s + 1 + len(x)] = x
                carry = int(h[s + len(x)])
            self.arrays.append(h)

    def joined(self, i: int, other: PrefixHashes, j: int) -> PrefixHashes:
        """The arrays of this text's first i characters followed by the other's first j."""
        out = object.__new__(PrefixHashes)
        out.n, out.arrays = i + j, []
        for h, g, base, p in zip(self.arrays, other.arrays, BASES, PRIMES, strict=True):
            x = g[1 : j + 1].astype(np.uint64)
            x *= np.uint64(pow(base, i, p))
            x += np.uint64(h[i])
            x %= np.uint64(p)
            out.arrays.append(np.concatenate([h[: i + 1], x.astype(np.uint32)]))
        return out

    def _spans(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The hashes of spans i to j, modulo prime k."""
        p, inverse = PRIMES[k], _INVERSES[k]
        x = self.arrays[k][j].astype(np.uint64)
        x += np.uint64(p)
        x -= self.arrays[k][i]
        x %= np.uint64(p)
        powers = _powers(inverse, p)
        if len(i) and i[-1] < _BLOCK:
            x *= powers[i]
        else:
            far = np.array([pow(inverse, b * _BLOCK, p) for b in range(int(i.max(initial=0)) // _BLOCK + 1)], np.uint64)
            x *= powers[i % _BLOCK] * far[i // _BLOCK] % np.uint64(p)
        return x % np.uint64(p)

    def span(self, i: int, j: int) -> int:
        """The hash of characters i to j, the same wherever the span stands."""
        out = 0
        for h, p, inverse in zip(self.arrays, PRIMES, _INVERSES, strict=True):
            out = out << 31 | (int(h[j]) - int(h[i])) % p * pow(inverse, i, p) % p
        return out

    def common(self, i: int, other: PrefixHashes, j: int) -> int:
        """The longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def short(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """32-bit hashes of spans, i in rising order."""
        return (self._spans(0, i, j) << np.uint64(31) | self._spans(1, i, j)).astype(np.uint32)

    def windows(self, start: int, stop: int) -> np.ndarray:
        """Mixed hashes of the spans of SPAN characters that start from start to stop."""
        i = np.arange(start, stop)
        return (self._spans(0, i, i + SPAN) * _MIX >> np.uint64(32)).astype(np.uint32)


class Anchors:
    """The smallest window hashes of any beginning of a text, from one pass over its windows."""

    def __init__(self, hashes: PrefixHashes):
        self.all = hashes.windows(0, max(0, hashes.n - SPAN + 1))
        self._places = np.arange(len(self.all))
        if len(self.all) > 8 * ANCHORS:  # enough of the smallest for almost any beginning
            self._places = np.flatnonzero(self.all < (8 * ANCHORS << 32) // len(self.all))

    def of_first(self, n: int) -> np.ndarray:
        """The anchors of the first n windows."""
        few = np.unique(self.all[self._places[: np.searchsorted(self._places, n)]])
        if len(few) < ANCHORS and len(self._places) < len(self.all):
            few = np.unique(self.all[:n])
        return few[:ANCHORS]


def ladder(n: int) -> list[int]:
    """The steps up to n: 1 to 8, then four an octave."""
    steps, k, by = [], 1, 1
    while k <= n:
        steps.append(k)
        if k >= 8 * by:
            by *= 2
        k += by
    return steps


def _written(h: PrefixHashes, anchors: np.ndarray) -> str:
    steps = np.array(ladder(h.n), np.int64)
    up = h.short(np.zeros(len(steps), np.int64), steps)
    down = h.short(h.n - steps[::-1], np.full(len(steps), h.n))[::-1]
    return f"{h.n:x}:{h.span(0, h.n):016x}:" + ":".join(x.astype(">u4").tobytes().hex() for x in (up, down, anchors))


def fingerprint(text: str) -> str:
    """Length, whole hash, prefix ladder, suffix ladder and anchors, in hex."""
    h = PrefixHashes(text)
    return _written(h, Anchors(h).of_first(h.n))


def _agreed(a: str, b: str, steps: list[int]) -> int:
    """The highest step at which two ladders agree, by binary search."""
    k = bisect_right(range(len(steps)), 0, key=lambda i: a[8 * i : 8 * i + 8] != b[8 * i : 8 * i + 8])
    return steps[k - 1] if k else 0


def _shared(a: str, b: str) -> float:
    """The estimated share of common spans in all spans of two texts."""
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a, b))
    least = sorted(x | y)[:ANCHORS]
    return sum(v in x and v in y for v in least) / len(least) if least else 0.0


def likeness(a: str, b: str) -> float:
    """The share of the longer text that the other has as well, 0 to 1."""
    if a == b:
        return 1.0
    (n, _, up, down, anchors), (m, _, other_up, other_down, other_anchors) = a.split(":"), b.split(":")
    n, m = int(n, 16), int(m, 16)
    steps = ladder(min(n, m))
    covered = _agreed(up, other_up, steps) + _agreed(down, other_down, steps)
    j = _shared(anchors, other_anchors)
    spans, most = max(0, n - SPAN + 1) + max(0, m - SPAN + 1), max(1, max(n, m) - SPAN + 1)
    return min(min(n, m) / max(n, m), max(covered / max(n, m), j * spans / (1 + j) / most))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, hashes, anchors, fingerprint) of each row that is no guest, followed by those of the next row."""
    before = None
    for batch in batches:
        for rows in slices(batch):
            for guest, doc, text in zip(rows.column("__guest").to_pylist(), rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                h = PrefixHashes(text)
                anchors = Anchors(h)
                now = (doc, text, h, anchors, _written(h, anchors.of_first(h.n)))
                if before is not None:
                    yield *before, *now
                before = None if guest else now
    assert before is None, "each part ends with a guest"


def _edited_print(h: PrefixHashes, own: Anchors, g: PrefixHashes, other: Anchors, cut: int) -> tuple[PrefixHashes, str]:
    """Hashes and fingerprint of the first text with its end replaced by the start of the second; little is hashed anew."""
    head, tail = h.n - cut, min(cut, g.n)
    new = h.joined(head, g, tail)
    across = new.windows(max(0, head - SPAN + 1), max(0, min(head, new.n - SPAN + 1)))
    parts = [own.of_first(max(0, head - SPAN + 1)), across, other.of_first(max(0, tail - SPAN + 1))]
    return new, _written(new, np.unique(np.concatenate(parts))[:ANCHORS])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = []
    for doc, text, h, own, print_, _, after, g, other, after_print in _pairs(batches):
        new = edited(text, after)
        hashes, new_print = _edited_print(h, own, g, other, len(text) // 4)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((doc, h.n, sha, print_, new_print, likeness(print_, new_print), likeness(print_, after_print), h.common(0, hashes, 0)))
        if len(rows) == 1000:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def _part(starts: list[tuple[int, int]]):
    """The part of an (id, hash): how many parts start at it or before, less one; and whether it starts that part."""
    kind = [("id", np.int64), ("h", np.int64)]
    bounds = np.array(starts, kind)

    @F.pandas_udf("part int, first boolean")
    def part(ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        own = np.empty(len(ids), kind)
        own["id"], own["h"] = ids, hashes
        at = np.searchsorted(bounds, own, side="right") - 1
        return pd.DataFrame({"part": at.astype(np.int32), "first": bounds[at] == own})

    return part


def consecutive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows dealt by id to parts of consecutive ids and sorted there, each part ending with a guest.

    The parts' first ids, each with the hash of its text, come from a sample of ids and hashes
    alone, one for each part; each part's first row is also sent, as a guest, to the part
    before, the very first to the last. Texts are shuffled once.
    """
    n = partitions(df.sparkSession)
    low = -(2**63)
    own_id, hashed = F.coalesce(F.col(id_col).cast("long"), F.lit(low)), F.xxhash64(text_of(text_col))
    keys = df.select(own_id.alias("id"), hashed.alias("h"))
    firsts = keys.repartitionByRange(n, "id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "h")).alias("f"))
    starts = sorted({(r.f.id, r.f.h) for r in firsts.collect()})  # one for each part
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), own_id.alias("__id"), hashed.alias("__h"))
    rows = rows.select("*", _part(starts or [(low, low)])("__id", "__h").alias("__at"))
    count = max(1, len(starts))
    at = F.col("__at.part")
    before = F.when(at == 0, F.lit(count - 1)).otherwise(at - 1)
    own, guest = F.struct(at.alias("p"), F.lit(False).alias("g")), F.struct(before.alias("p"), F.lit(True).alias("g"))
    copies = F.when(F.col("__at.first"), F.array(own, guest)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "__id", "__h", F.explode(copies).alias("__c")).select("doc_id", "text", "__id", "__h", F.col("__c.p").alias("__p"), F.col("__c.g").alias("__guest"))
    return dealt.repartitionById(count, F.col("__p")).sortWithinPartitions("__guest", "__id", "__h", "text"), count


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, their likenesses, and how long the two texts agree."""
    rows, _ = consecutive(df, id_col, text_col)
    return rows.select("__guest", "doc_id", "text").mapInArrow(_digests, _SCHEMA)
