"""Mixing to target weights under soft membership of domains.

A classifier (naive Bayes over hashed words, its evidence per word scaled by one
temperature) learns domains from labelled rows and gives every document a posterior
p over the domains. With t tokens and a rate r >= 0, a document adds r t p to the
domains' expected totals. The rates minimise the squared distances of these totals to
the targets, each divided by its domain's total at rate 1, by projected gradient:

    r <- max(floor, r - sum over d of p[d] (total[d] - target[d]) / scale[d])

(and at most a ceiling, where one is set: a target that hardly any document can serve
would otherwise ask for thousands of copies of those few).

Rounds go on until every domain's total is within `tolerance` of its own target, or no
total moves any more: then targets are out of reach of the floor and the ceiling. Where a
target isn't met, so also where `rounds` run out, a warning tells by how much, and
`Mixture.settled` and `Mixture.residuals` do.

The step is that of the metric in which a document weighs its tokens; there the
gradient's constant is 1 for these scales, so a step of 1 always descends. A round is one
Spark aggregation of as many sums as there are domains, and the residuals of all rounds
reproduce a document's rate from its posterior alone, wherever it is next needed.

Cases: null text counts as empty; a text without words has the prior as posterior, no
tokens, and keeps rate 1 unless its domain's residuals move it. Labelled rows with a null or unknown
domain don't count; of repeated labels of one id the largest row counts; without any, posteriors are even. Repeated rows have a rate each.
An empty table gives no rows; other columns are ignored by `rates` and carried along by
`mixed`.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_names, text_of, written
from ledgerloom.llm.kneser_ney import words_of
from ledgerloom.llm.tokens import slices


@dataclass(frozen=True)
class Settings:
    """labelled_rows: at most so many labelled rows are learned from, the first by a hash of their id.

    size: total tokens of the mixture; None for those of the corpus, or "floor" for the
    smallest at which no domain's target is below its total at the floor's rate.
    tolerance: how far a domain's total may end from its target, as a share of it.
    stalled: a round that moves no total by more than this share of its target ends the descent.
    """

    labelled_rows: int = 20_000
    buckets: int = 1 << 16
    smoothing: float = 0.1
    rounds: int = 100
    tolerance: float = 1e-3
    stalled: float = 1e-4
    floor: float = 0.0
    ceiling: float | None = None
    size: float | str | None = None


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # bucket x domain, log P(word | domain)
    prior: np.ndarray
    scale: float

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and its mean log-likelihood of a word in each domain."""
        codes, at, hashes = words_of(texts)
        own = self.weights[(hashes % np.uint64(len(self.weights))).astype(np.int64)]
        own[-1] = 0  # the end token
        n = np.diff(at) - 1
        total = np.add.reduceat(own[codes], at[:-1], axis=0) if len(n) else np.zeros((0, len(self.domains)))
        return n, total / np.maximum(n, 1)[:, None]

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, mean = self.means(texts)
        return n, posterior(mean, self.prior, self.scale)


def posterior(mean: np.ndarray, prior: np.ndarray, scale: float) -> np.ndarray:
    z = np.log(prior) + scale * mean
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_scale(mean: np.ndarray, domain: np.ndarray, prior: np.ndarray) -> float:
    """The evidence's scale of the highest likelihood, by golden sections of its logarithm."""

    def loss(log_scale: float) -> float:
        return -float(np.log(np.maximum(posterior(mean, prior, np.exp(log_scale))[np.arange(len(domain)), domain], 1e-12)).mean())

    low, high, ratio = -2.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learn(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """The classifier, from a bounded sample of the labelled rows; `domain` may use both tables' columns."""
    # of repeated labels of one id the largest row counts
    once = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.struct(*[c for c in labels.columns if c != "doc_id"])).alias("l"))
    known = once.select("doc_id", "l.*").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.labelled_rows)
    columns = [c for c in docs.columns if c not in (id_col, text_col) and c not in known.columns]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *columns)
    at = F.array_position(F.array(*map(F.lit, domains)), domain.cast("string")) - 1
    sample = rows.join(F.broadcast(known), "doc_id").select("text", at.cast("int").alias("domain")).filter("domain >= 0")
    sample = written(sample, "labelled")
    size, k = settings.buckets, len(domains)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, k), np.int64)
        for batch in batches:
            for part in slices(batch):
                codes, at, hashes = words_of(part.column("text"))
                bucket = (hashes % np.uint64(size)).astype(np.int64)[codes]
                which = np.repeat(np.asarray(part.column("domain"), np.int64), np.diff(at))
                real = codes != len(hashes) - 1
                total += np.bincount(bucket[real] * k + which[real], minlength=size * k).reshape(size, k)
        full = np.flatnonzero(total.any(axis=1))
        for s in range(0, len(full), 10_000):
            some = full[s : s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, d]) for d in range(k))], names=["bucket", *(f"n{d}" for d in range(k))])

    names = [f"n{d}" for d in range(k)]
    counted = sample.mapInArrow(count, "bucket long, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # at most `buckets` rows
    n = np.zeros((size, k))
    n[counted["bucket"].to_numpy(np.int64)] = counted[names].to_numpy(float)
    n += settings.smoothing
    docs_of = np.ones(k)
    for r in sample.groupBy("domain").count().collect():
        docs_of[r.domain] += r["count"]
    found = Classifier(domains, np.log(n / n.sum(axis=0)), docs_of / docs_of.sum(), 1.0)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, m = found.means(part.column("text"))
                some = words > 0
                yield pa.RecordBatch.from_arrays([part.column("domain").filter(pa.array(some)), pa.array(m[some].tolist(), pa.list_(pa.float64()))], names=["domain", "mean"])

    pairs = sample.mapInArrow(mean, "domain int, mean array<double>").collect()  # at most labelled_rows
    if pairs:
        found.scale = fit_scale(np.array([r.mean for r in pairs]), np.array([r.domain for r in pairs]), found.prior)
    return found


def _shares_off(totals: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Distances by target; those of a target of zero by the smallest other one."""
    by = np.where(targets > 0, targets, targets[targets > 0].min() if (targets > 0).any() else 1.0)
    return (totals - targets) / by


@dataclass
class Mixture:
    classifier: Classifier
    floor: float
    ceiling: float
    targets: np.ndarray
    totals: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    settled: bool = False

    @property
    def residuals(self) -> dict[str, float]:
        """How far each domain's total is from its target, as a share of it."""
        return dict(zip(self.classifier.domains, (_shares_off(self.totals, self.targets)).tolist(), strict=True))

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates from posteriors, by the steps of all rounds."""
        r = np.full(len(p), max(1.0, self.floor))
        for v in self.steps:
            r = np.clip(r - p @ v, self.floor, self.ceiling)
        return r


def predictions(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, and a posterior p0, p1, ... for each domain."""
    names = [f"p{d}" for d in range(len(classifier.domains))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                n, p = classifier.posteriors(rows.column("text"))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), *map(pa.array, np.ascontiguousarray(p.T))], names=["doc_id", "tokens", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, tokens long, " + ", ".join(f"{n} double" for n in names))


def solve(predicted: DataFrame, classifier: Classifier, targets: dict[str, float], settings: Settings) -> tuple[Mixture, DataFrame]:
    """The mixture, and the predictions (a written table) with their rates."""
    k = range(len(classifier.domains))
    share = np.array([targets[d] for d in classifier.domains], float)
    if (share < 0).any() or not share.sum() > 0:
        raise ValueError("target weights must be nonnegative, and some positive")
    share /= share.sum()

    def totals(df: DataFrame) -> np.ndarray:
        row = df.agg(*[F.coalesce(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{d}")), F.lit(0.0)) for d in k]).first()
        return np.array(row, float)

    rated = predicted.withColumn("rate", F.lit(max(1.0, settings.floor)))
    now = totals(rated)
    natural = now / max(1.0, settings.floor)
    if settings.size == "floor":
        size = max((settings.floor * n / s for n, s in zip(natural, share, strict=True) if s > 0), default=0.0)
    else:
        size = natural.sum() if settings.size is None else float(settings.size)
    ceiling = np.inf if settings.ceiling is None else max(settings.floor, settings.ceiling)
    mixture = Mixture(classifier, settings.floor, ceiling, share * size, now)
    scale = np.maximum(natural, 1e-9 * max(1.0, natural.sum()))
    moved_by = np.inf
    while natural.sum() > 0 and np.abs(_shares_off(now, mixture.targets)).max() > settings.tolerance and moved_by > settings.stalled:
        if len(mixture.steps) == settings.rounds:
            break
        v = (now - mixture.targets) / scale
        mixture.steps.append(v)
        moved = F.col("rate") - sum((F.col(f"p{d}") * F.lit(float(v[d])) for d in k), F.lit(0.0))
        rated = rated.withColumn("rate", F.least(F.lit(float(ceiling)), F.greatest(F.lit(float(settings.floor)), moved)))
        if len(mixture.steps) % 10 == 0:
            rated = written(rated, "rates")
        before, now = now, totals(rated)
        mixture.totals = now
        moved_by = float(np.abs(_shares_off(now, mixture.targets) - _shares_off(before, mixture.targets)).max())
    else:
        mixture.settled = True
    if natural.sum() > 0 and np.abs(_shares_off(now, mixture.targets)).max() > settings.tolerance:
        why = "out of reach between the floor and the ceiling" if mixture.settled else f"not reached in {settings.rounds} rounds"
        warnings.warn(f"targets {why}; shares off by {mixture.residuals}", stacklevel=2)
    return mixture, rated


def rates(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], settings: Settings | None = None) -> DataFrame:
    """One row per document: doc_id, tokens, domain (the likeliest), p_<domain> for each, rate."""
    settings = settings or Settings()
    classifier = learn(docs, labels, domain, list(targets), settings)
    mixture, rated = solve(written(predictions(docs, classifier), "posteriors"), classifier, targets, settings)
    names = list(targets)
    best = F.greatest(*[F.col(f"p{d}") for d in range(len(names))]) if len(names) > 1 else F.col("p0")
    likeliest = F.coalesce(*[F.when(F.col(f"p{d}") == best, F.lit(n)) for d, n in enumerate(names)])
    return rated.select("doc_id", "tokens", likeliest.alias("domain"), *[F.col(f"p{d}").alias(f"p_{n}") for d, n in enumerate(names)], "rate")


def mixed(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, each as often as its rate says.

    A rate's whole part is a number of copies; a hash of id and text decides on its fraction.
    Documents are classified once more here, which is cheaper than a shuffle of all texts to
    join them with their rates.
    """
    settings = settings or Settings()
    classifier = learn(docs, labels, domain, list(targets), settings, id_col, text_col)
    mixture, _ = solve(written(predictions(docs, classifier, id_col, text_col), "posteriors"), classifier, targets, settings)
    at, names = docs.columns.index(text_col), docs.columns

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            own = pa.RecordBatch.from_arrays([texts, *batch.columns], names=["text", *(str(i) for i in range(batch.num_columns))])
            for part in slices(own):
                r = mixture.rates(classifier.posteriors(part.column("text"))[1])
                draw = (np.asarray(part.column(f"{len(names)}"), np.int64).astype(np.uint64) >> np.uint64(11)) * 2.0**-53
                copies = np.floor(r).astype(np.int64) + (draw < r - np.floor(r))
                rows = pa.RecordBatch.from_arrays([part.column(str(i)) for i in range(len(names))], names=names)
                for n in range(int(copies.max(initial=0))):  # a copy at a time, so that no batch grows
                    yield rows.filter(pa.array(copies > n))

    (draw,) = free_names(docs, "__draw")
    drawn = docs.withColumn(draw, F.xxhash64(F.col(id_col), F.col(text_col)))
    return drawn.mapInArrow(repeat, docs.schema)
