"""Text scores under an interpolated modified Kneser-Ney model of word pairs.

Training, all of it Spark jobs over all training documents:

1. Each task counts its words; words go by ranges of their 64-bit hash to the tasks that
   sum them and write a sorted array of hashes and one of counts. A word's place in
   the arrays is its number, so numbers are dense and exact.
2. Each task counts its pairs of numbers; pairs are dealt evenly by a hash of both, so
   that frequent words are no task's work alone, summed, and written as sorted arrays.
   The task that has a part of the pairs also counts, by word, how many different
   words went before it, and by how often pairs occur, how many go on from it.
3. Those partial counts go to the ranges of the words, and are summed and written
   beside the words.

Tasks send each other sorted, compressed blocks: a row for each pair of tasks. To score,
workers map the arrays into memory and look up a slice's different words and pairs in
sorted order, by binary search. On a store without files to map, a worker reads and holds
parts up to `stores.HELD`. Counts of pairs have 64 bits where one needs them; word numbers
have 32, and a vocabulary beyond that is an error.

p(w|u) = max(c(uw) - D, 0) / c(u) + g(u) q(w), where q is the same one level down, on
counts of different words before w, interpolated with 1 / (V + 1). A text's first word
follows the end token, which also closes it.

Cases: null text counts as empty and has the end token alone. A null id isn't held out.
Without training documents every token has probability 1. Repeated rows count and are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import partitions, shared_path, text_of
from ledgerloom.llm.stores import mapped, mapped_counts, save, save_counts, store_of
from ledgerloom.llm.tokens import slices

#: The end token stands for bytes that no word can be.
END = b" "
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "part int, blocks array<binary>"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as codes, each text's start (with the end), and the 64-bit hash of each code.

    Every text ends with the end token, the last code.
    """
    from xxhash import xxh64_intdigest

    whole = texts.take(pa.array(np.arange(len(texts))))  # Arrow's ascii_lower misreads slices that were cast
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole).cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    codes, at = np.asarray(coded.indices, np.int64), np.asarray(lists.offsets, np.int64)
    values = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in values:  # before or after outer spaces
        real = codes != values.index(b"")
        at = np.concatenate([[0], np.cumsum(real)])[at]
        codes = codes[real]
    hashes = np.fromiter(map(xxh64_intdigest, [*values, END]), np.uint64, len(values) + 1)
    codes = np.insert(codes, at[1:], len(values))
    return codes, at + np.arange(len(at)), hashes


def pack(array: np.ndarray) -> bytes:
    """Bytes by significance, compressed: sorted numbers share their high bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.itemsize).T).tobytes())


def unpack(block: bytes, dtype: str) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Different keys, sorted, and the sums of their counts."""
    if not len(keys):
        return [keys, *counts]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[starts], *(np.add.reduceat(c[order], starts) for c in counts)]


def dealt(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row of packed blocks for each part, from columns in order of the keys."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    columns = [c[order] for c in columns]
    rows = [(int(part[a]), [pack(c[a:b]) for c in columns]) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
    for s in range(0, len(rows), 500):
        some = rows[s : s + 500]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([b for _, b in some], pa.list_(pa.binary()))], names=["part", "blocks"])


def gathered(batches: Iterator[pa.RecordBatch], dtypes: list[str]) -> tuple[int, list[np.ndarray]]:
    """The part that this task has, and the columns of all its blocks."""
    found, part = [[] for _ in dtypes], -1
    for batch in batches:
        for p, blocks in zip(batch.column("part").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            part = p
            for own, block, t in zip(found, blocks, dtypes, strict=True):
                own.append(unpack(block, t))
    return part, [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(found, dtypes, strict=True)]


def range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash space, equal ranges in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pair_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * _MIX >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """D(0) to D(3+) from how many keys occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in zip((1, 2, 3), raw, strict=True))])


def checked_vocabulary(size: int) -> None:
    """A pair is two 32-bit word numbers in one key; with more words than these can tell apart there is no model."""
    if size >= 1 << 32:
        raise OverflowError(f"{size} different words; word numbers have 32 bits")


@dataclass
class Model:
    """Where the arrays lie, and what is known of the whole corpus."""

    path: str
    parts: int
    sizes: list[int]  # words in each part
    pairs: list[int]  # pairs in each part
    tokens: int = 0
    level2: np.ndarray = field(default_factory=lambda: np.zeros(4))
    level1: np.ndarray = field(default_factory=lambda: np.zeros(4))
    before: int = 0  # different pairs
    rest: float = 1.0  # the mass of q that goes to 1 / (V + 1)

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @property
    def vocabulary(self) -> int:
        return int(self.first[-1])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of different hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        cuts = np.searchsorted(range_of(hashes[order], self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            if not self.sizes[p]:
                continue
            at = order[cuts[p] : cuts[p + 1]]
            keys = mapped(f"{self.path}/words-{p}", "<u8")
            k = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            out[at] = np.where(keys[k] == hashes[at], k + self.first[p], -1)
        return out

    def word_values(self, numbers: np.ndarray, names: dict[str, str]) -> list[np.ndarray]:
        """For each name, the values of the words; 0 for unknown ones."""
        out = [np.zeros(len(numbers)) for _ in names]
        order = np.argsort(numbers)
        cuts = np.searchsorted(numbers[order], self.first)
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[p] : cuts[p + 1]]
            for values, (name, dtype) in zip(out, names.items(), strict=True):
                values[at] = mapped(f"{self.path}/{name}-{p}", dtype)[numbers[at] - self.first[p]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of different pairs, sorted; 0 for unknown ones."""
        out = np.zeros(len(keys), np.int64)
        part = pair_part(keys, self.parts)
        order = np.argsort(part.astype(np.uint16) if self.parts < 1 << 16 else part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            if not self.pairs[p]:
                continue
            at = order[cuts[p] : cuts[p + 1]]
            own = mapped(f"{self.path}/pairs-{p}", "<u8")
            k = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
            out[at] = np.where(own[k] == keys[at], mapped_counts(f"{self.path}/pair-counts-{p}", len(own))[k], 0)
        return out


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(text_of(text_col).alias("text"))


def train(df: DataFrame, path: str | None = None, text_col: str = "text") -> Model:
    """Count the texts and write the model's arrays under `path`, in the shared folder unless given."""
    spark = df.sparkSession
    parts, path = partitions(spark), path or shared_path(spark, "pairs-model")
    store, root = store_of(path)
    store.create_dir(root, recursive=True)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for batch in batches:
            for rows in slices(batch):
                codes, _, hashes = words_of(rows.column("text"))
                n = np.bincount(codes, minlength=len(hashes))
                keys.append(hashes[n > 0])
                counts.append(n[n > 0])
                if sum(map(len, keys)) > 4_000_000:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [c]
        k, c = summed(np.concatenate(keys), np.concatenate(counts))
        yield from dealt(range_of(k, parts), [k, c.astype("<u8")])

    def sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, columns = gathered(batches, ["<u8", "<u8"])
        if part < 0:
            return
        keys, counts = summed(*columns)
        save(f"{path}/words-{part}", keys)
        save(f"{path}/counts-{part}", counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    dealt_words = _texts(df, text_col).mapInArrow(count_words, _BLOCKS).repartitionById(parts, F.col("part"))
    stats = {r.part: r for r in dealt_words.mapInArrow(sum_words, "part int, n long, total long").collect()}  # a row for each part
    model = Model(path, parts, [stats[p].n if p in stats else 0 for p in range(parts)], [0] * parts, sum(r.total for r in stats.values()))
    if not model.tokens:
        return model
    checked_vocabulary(model.vocabulary)
    words = model

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for batch in batches:
            for rows in slices(batch):
                codes, _, hashes = words_of(rows.column("text"))
                numbers = words.numbers(hashes).astype(np.uint64)[codes]
                before = np.concatenate([[numbers[-1]], numbers[:-1]])  # a text's first word follows the end token
                k, c = np.unique(before << np.uint64(32) | numbers, return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 4_000_000:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [c], 0
        k, c = summed(np.concatenate(keys), np.concatenate(counts))
        yield from dealt(pair_part(k, parts), [k, c.astype("<u8")])  # packed by significance, so zero bytes cost little

    def sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (keys, counts) = gathered(batches, ["<u8", "<u8"])
        if part < 0:
            return
        keys, counts = summed(keys, counts.astype(np.int64))
        save(f"{path}/pairs-{part}", keys)
        save_counts(f"{path}/pair-counts-{part}", counts)
        save(f"{path}/pair-stats-{part}", np.array([len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))], "<u8"))
        # by word: different words before it, and pairs from it that occur once, twice, more often
        after, w = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        u = keys >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.empty(0, np.int64)
        from_ = [np.add.reduceat(x.astype(np.int64), starts) for x in (counts == 1, counts == 2, counts > 2)] if len(u) else [starts] * 3
        numbers = np.union1d(after, u[starts])
        columns = [np.zeros(len(numbers), "<u4") for _ in range(4)]
        columns[0][np.searchsorted(numbers, after)] = w
        for c, x in zip(columns[1:], from_, strict=True):
            c[np.searchsorted(numbers, u[starts])] = x
        where = np.searchsorted(words.first, numbers.astype(np.int64), side="right") - 1
        yield from dealt(where, [numbers.astype("<u4"), *columns])

    def sum_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (numbers, *columns) = gathered(batches, ["<u4"] * 5)
        if part < 0:
            return
        at = numbers.astype(np.int64) - int(words.first[part])
        totals = [np.bincount(at, weights=c, minlength=words.sizes[part]).astype("<u4") for c in columns]
        for name, c in zip(("befores", "once", "twice", "often"), totals, strict=True):
            save(f"{path}/{name}-{part}", c)
        n = [int((totals[0] == k).sum()) for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_pydict({"total": [int(totals[0].astype(np.int64).sum())], "known": [int((totals[0] > 0).sum())], "n": pa.array([n], pa.list_(pa.int64()))})

    dealt_pairs = _texts(df, text_col).mapInArrow(count_pairs, _BLOCKS).repartitionById(parts, F.col("part"))
    links = dealt_pairs.mapInArrow(sum_pairs, _BLOCKS).repartitionById(parts, F.col("part"))
    found = links.mapInArrow(sum_links, "total long, known long, n array<long>").collect()  # a row for each part

    n2 = np.zeros(4, np.int64)
    for p in range(parts):
        if store.get_file_info(f"{root}/pair-stats-{p}").type != FileType.NotFound:
            size, *n = mapped(f"{path}/pair-stats-{p}", "<u8").tolist()
            model.pairs[p] = size
            n2 += n
    n1 = np.sum([r.n for r in found], axis=0)
    model.before = sum(r.total for r in found)
    model.level2, model.level1 = discounts(n2), discounts(n1)
    more = sum(r.known for r in found) - int(n1[:2].sum())
    model.rest = float(model.level1[1] * n1[0] + model.level1[2] * n1[1] + model.level1[3] * more) / model.before
    return model


def log_probabilities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's count in training and log10 probability, and each text's start (with the end)."""
    codes, at, hashes = words_of(texts)
    if not model.tokens:
        return np.zeros(len(codes)), np.zeros(len(codes)), at
    numbers = model.numbers(hashes)
    count, befores, once, twice, often = model.word_values(numbers, {"counts": "<u8", "befores": "<u4", "once": "<u4", "twice": "<u4", "often": "<u4"})
    d1, d2 = model.level1, model.level2
    q = (befores - d1[np.minimum(befores, 3).astype(np.int64)]) / model.before + model.rest / (model.vocabulary + 1)
    known = numbers >= 0
    g = np.ones(len(numbers))
    g[known] = (d2[1] * once + d2[2] * twice + d2[3] * often)[known] / count[known]
    before = np.concatenate([codes[-1:], codes[:-1]])
    both = known[before] & known[codes]
    keys, where = np.unique(numbers[before[both]].astype(np.uint64) << np.uint64(32) | numbers[codes[both]].astype(np.uint64), return_inverse=True)
    pairs = np.zeros(len(codes))
    pairs[both] = model.pair_counts(keys)[where]
    own = pairs - d2[np.minimum(pairs, 3).astype(np.int64)]
    p = own / np.maximum(count[before], 1) + g[before] * q[codes]
    return count[codes], np.log10(p), at


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that aren't learned from: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, characters=8_000_000):
                counts, logs, at = log_probabilities(model, rows.column("text"))
                base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
                known = np.add.reduceat((counts > 0).astype(np.int64), at[:-1])
                columns = [np.diff(at), known, np.add.reduceat(base, at[:-1]), np.add.reduceat(logs, at[:-1])]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def language_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the documents that aren't held out, and score all."""
    return scored(df, train(df.filter(~held_out(id_col)), text_col=text_col), id_col, text_col)
