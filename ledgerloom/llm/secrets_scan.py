"""Secret scan: named patterns, and windows of high Shannon entropy in candidate strings.

Base patterns, per kind leftmost and non-overlapping:
  assign  a name like password or api_key, then : or =, then a value of 6 characters or more;
  access  AKIA and capitals or digits, 20 characters or more;
  hex     24 lower-case hex digits or more.
The entropy pass takes runs of 20 or more key characters as candidates, tells their
character class (hex, letters and digits, or with symbols), and slides a window over
each, updating the counts and the sum of c * log2(c) as one character enters and one
leaves. Windows at or above the class's threshold are joined into `entropy` spans,
unless the allow-list knows the candidate, the window belongs to an example key, or a
base span covers it.

Cases: null text counts as empty and has no spans; texts of any length are scanned
whole; repeated rows are scanned each; an empty table gives no rows; other columns are
ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of
from ledgerloom.llm.tokens import slices

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the maximal run, so the same as all runs of 20 or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: A slug's or path's part: letters alone, digits alone, or a few of both; a longer mixture may be a key.
_PLAIN = r"(?:[a-z]+|[0-9]+|[a-z0-9]{1,4})"
#: Candidates that are no secrets: identifiers with a public form, words, numbers, slugs and paths.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z/_=-]*",
    r"[0-9/_=+-]*",
    rf"(?:{_PLAIN}[/_-])+{_PLAIN}",
)
#: Words that mark an example key, and how far from one, in characters, windows are taken as part of it.
EXAMPLES, EXAMPLE_REACH = r"EXAMPLE", 40


@dataclass(frozen=True)
class EntropyRule:
    """Window length, and bits per character from which a window of each class counts."""

    window: int = 20
    hex: float = 3.2
    alnum: float = 3.8
    symbols: float = 3.7
    allowed: tuple[str, ...] = ALLOWED
    examples: str = EXAMPLES
    example_reach: int = EXAMPLE_REACH

    def threshold(self, candidate: str) -> float:
        if all(c in "0123456789abcdefABCDEF" for c in candidate):
            return self.hex
        return self.alnum if candidate.isalnum() else self.symbols


def window_entropies(text: str, window: int) -> list[float]:
    """Shannon entropy of every window, by incremental counts."""
    counts: dict[str, int] = {}
    terms = [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    total, out = 0.0, []
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        total += terms[k + 1] - terms[k]
        counts[c] = k + 1
        if i + 1 >= window:
            out.append(math.log2(window) - total / window)
            gone = text[i + 1 - window]
            k = counts[gone]
            total += terms[k - 1] - terms[k]
            counts[gone] = k - 1
    return out


def entropy_spans(text: str, rule: EntropyRule) -> list[tuple[int, int]]:
    allowed = re.compile("|".join(f"(?:{x})" for x in rule.allowed)) if rule.allowed else None
    out = []
    for m in _CANDIDATE.finditer(text):
        candidate = m[0]
        if len(candidate) < rule.window or allowed and allowed.fullmatch(candidate):
            continue
        shown = [(x.start() - rule.example_reach, x.end() + rule.example_reach) for x in re.finditer(rule.examples, candidate)]
        least, start, end = rule.threshold(candidate), -1, -1
        for i, bits in enumerate(window_entropies(candidate, rule.window)):
            if bits < least or any(a <= i and i + rule.window <= b for a, b in shown):
                continue
            if start >= 0 and i > end:
                out.append((m.start() + start, m.start() + end))
                start = -1
            start, end = (i if start < 0 else start), i + rule.window
        if start >= 0:
            out.append((m.start() + start, m.start() + end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def all_spans(text: str, rule: EntropyRule) -> tuple[list, list]:
    """Base spans, and base with entropy spans; each by start, then kind."""
    base = base_spans(text)
    more = [(a, b, "entropy") for a, b in entropy_spans(text, rule) if not any(s <= a and b <= e for s, e, _ in base)]
    order = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base, key=order), sorted(base + more, key=order)


def secret_spans(df: DataFrame, rule: EntropyRule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts of base kinds, base spans and all spans as arrays."""
    rule = rule or EntropyRule()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                both = [all_spans(t, rule) for t in rows.column("text").to_pylist()]
                base, whole = ([[{"kind": k, "start": a, "end": b} for a, b, k in x[i]] for x in both] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(base, span), pa.array(whole, span)], names=["doc_id", "base", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(scan, f"doc_id long, base {kind}, spans {kind}")


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def secret_digests(df: DataFrame, rule: EntropyRule | None = None) -> DataFrame:
    """Counts and span strings of every document."""
    spans = secret_spans(df, rule)
    n = [f"cast(size(filter(base, s -> s.kind = '{k}')) as long) AS n_{k}" for k in KINDS[:3]]
    return spans.selectExpr("doc_id", *n, f"sha2({joined('base')}, 256) AS base_sha256", f"{joined('spans')} AS spans")
