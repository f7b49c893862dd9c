"""Ranked lexical search as a blocked sparse matrix product.

An item's row holds the multiplicity of its terms, a term's row the impact of the term on
each document, and the scores are the product of the two matrices, in 64-bit integers.
Items are taken in blocks whose terms are bounded in number, and documents in blocks of
`block` rows. For a block of items the texts are read once: a document becomes its length and
the counts of those terms that the items have (its column of the second matrix), which are
written. From these come the corpus counts, and then each task makes the product of
the items with its blocks of documents: Gustavson's way, an item's row being merged from the
rows of its terms, and keeps the k best of each item over all its blocks. What the tasks kept
is reduced in two steps, within salted buckets first.

Only a block of items, whose terms are at most `MOST_TERMS` (a larger item is an error), goes
through the driver, to every task.

Cases: null text has no terms, of documents and of items; such documents aren't counted and
such items get no rows; rows of one item id are one item with the terms of all; repeated
documents are ranked each; a null document id ranks last among equal scores; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import partitions, text_of, written
from ledgerloom.llm.tokens import slices

#: Different (item, term) pairs of a block of items, all of which every task holds.
MOST_TERMS = 2_000_000
_LAST = np.iinfo(np.int64).max
#: The bytes of UTF-8: those of terms, A to Z in lower case, and a space for every other.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 text in turn."""
    return text.translate(_TABLE).split()


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, times) of all items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                found = [(i, t, n) for i, text in zip(rows.column("item_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), strict=True) for t, n in Counter(terms(text)).items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["item_id", "term", "times"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _blocks(own: DataFrame) -> list[DataFrame]:
    """The items in blocks of bounded terms. own: a written table of (item_id, term, times)."""
    sizes = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("whole")).first()
    if not most.whole:
        return []
    if most.most > MOST_TERMS:
        raise ValueError(f"an item of more than {MOST_TERMS} different terms")
    blocks = -(-most.whole // MOST_TERMS)
    while True:
        dealt = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= MOST_TERMS:
            return [dealt.filter(F.col("block") == b).drop("block") for b in range(blocks)]
        blocks *= 2


def _columns(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): each text's length and its counts of the known terms; texts without terms are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for rows in slices(batch):
                ids, lengths, ends, at, tfs = [], [], [0], [], []
                for i, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    own = terms(text)
                    if not own:
                        continue
                    counted = Counter(own)
                    met = counted.keys() & known.keys()
                    at.extend(map(known.__getitem__, met))
                    tfs.extend(map(counted.__getitem__, met))
                    ids.append(i)
                    lengths.append(len(own))
                    ends.append(len(at))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((at, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def term_weight(n: int, df: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how rare a term is, rounded down."""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def _impacts(batch: pa.RecordBatch, weights: np.ndarray, documents: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's matrix by term: where each term's row starts, its documents and its impacts; and the documents' ids."""
    # a batch may be a slice: flatten() knows, values doesn't
    at, tf = (np.asarray(batch.column(c).flatten()) for c in ("terms", "tfs"))
    of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column("terms"))))
    m = 100 - 25 + (25 * np.asarray(batch.column("n")) * documents) // words
    impact = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[of]))
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(weights) + 1))
    return starts, of[order], impact[order], np.asarray(pc.fill_null(batch.column("doc_id"), _LAST))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The positions of the k highest scores above 0, equal ones by ascending id."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        least = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= least]
    return found[np.lexsort((ids[found], -scores[found]))][:k]


def _product(columns: DataFrame, rows: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, words: int, k: int, block: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents of each item."""
    sent = columns.sparkSession.sparkContext.broadcast((rows, weights))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weights = sent.value
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(rows)
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                starts, docs, impacts, ids = _impacts(batch, weights, documents, words)
                for i, (_, own, times) in enumerate(rows):
                    scores = np.zeros(len(ids), np.int64)
                    for t, n in zip(own, times, strict=True):
                        a, b = starts[t], starts[t + 1]
                        scores[docs[a:b]] += n * impacts[a:b]  # a document is in a term's row once
                    new = _best(scores, ids, k)
                    both = np.concatenate([kept[i][0], scores[new]]), np.concatenate([kept[i][1], ids[new]])
                    last = _best(*both, k)
                    kept[i] = both[0][last], both[1][last]
        names = np.repeat([r[0] for r in rows], [len(s) for s, _ in kept])
        ids = np.concatenate([d for _, d in kept])
        found = [pa.array(names, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(np.concatenate([s for s, _ in kept]), pa.int64())]
        yield pa.RecordBatch.from_arrays(found, names=["item_id", "doc_id", "score"])

    return columns.mapInArrow(multiply, "item_id long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each item's k best of what tasks kept: of each salted bucket first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(partitions(found.sparkSession))))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("place") <= k)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = 8192, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of every item: item_id, rank from 1, doc_id, score."""
    spark = docs.sparkSession
    own = written(_item_terms(items.filter(F.col(item_id).isNotNull()), item_id, item_text), "item-terms")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in _blocks(own):
        table = part.toArrow()  # MOST_TERMS rows at most
        if not table.num_rows:
            continue
        names = table.column("term").combine_chunks().dictionary_encode()
        known = {bytes(t): i for i, t in enumerate(names.dictionary.to_pylist())}
        columns = written(_columns(docs, known, id_col, text_col), "columns")
        whole = columns.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
        if not whole.documents:
            return out
        df = np.zeros(len(known), np.int64)
        for r in columns.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each known term
            df[r["term"]] = r["count"]
        items_, at, times = (np.asarray(x) for x in (table.column("item_id"), names.indices, table.column("times")))
        order = np.lexsort((at, items_))
        cuts = np.flatnonzero(np.diff(items_[order])) + 1
        rows = [(int(items_[g[0]]), at[g], times[g].astype(np.int64)) for g in np.split(order, cuts)]
        kept = _product(columns, rows, term_weight(whole.documents, df), whole.documents, whole.words, k, block)
        out = out.unionByName(_top(written(kept, "kept"), k))
    return out


#: The same over `documents` and `benchmark` as DuckDB SQL.
ORACLE = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, lower_ascii AS words FROM (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS lower_ascii FROM documents)
        WHERE len(words) > 0
    ), s AS (
        SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM d
    ), p AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL
    ), w AS (
        SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
    ), q AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), m AS (
        SELECT r, doc_id, 75 + (25 * len(words) * n_docs) // n_words AS m FROM d, s
    ), x AS (
        SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
        FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL) JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL
    ), y AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 20
"""
