import random

import numpy as np
import pytest
from helpers import AWKWARD, docs
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import Classifier, Settings, learn, mixed, predictions, rates, solve

WORDS = {"a": "alpha apple arch aunt".split(), "b": "bear bird book boat".split(), "c": "cat cup corn cake".split()}


def corpus(n=300):
    r = random.Random(13)
    rows = []
    for i in range(n):
        d = r.choices("abc", weights=(6, 3, 1))[0]
        w = [r.choice(WORDS[d if r.random() < 0.9 else r.choice("abc")]) for _ in range(r.randrange(5, 60))]
        rows.append((i, " ".join(w), d))
    return rows


def tables(spark, rows):
    df = docs(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, d) for i, _, d in rows if i % 3 == 0], "doc_id long, kind string")
    return df, labels


def descent(p, t, targets, floor, rounds):
    """The same problem with dense matrices."""
    r = np.full(len(p), max(1.0, floor))
    scale = p.T @ t
    for _ in range(rounds):
        r = np.maximum(floor, r - p @ ((p.T @ (t * r) - targets) / scale))
    return r


def test_rates_against_dense_descent_and_targets(spark):
    rows = corpus()
    df, labels = tables(spark, rows)
    shares = {"a": 0.3, "b": 0.3, "c": 0.4}
    got = rates(df.withColumn("rate", F.lit("clash")), labels, F.col("kind"), shares, Settings(rounds=200, tolerance=1e-9, stalled=0.0)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(300))
    p, t = np.array([[r.p_a, r.p_b, r.p_c] for r in got]), np.array([r.tokens for r in got], float)
    assert t.tolist() == [len(x.split()) for _, x, _ in rows]
    r = np.array([r.rate for r in got])
    totals, targets = p.T @ (t * r), t.sum() * np.array(list(shares.values()))
    assert np.allclose(totals, targets, rtol=1e-3) and (r >= 0).all()
    assert np.allclose(r, descent(p, t, targets, 0.0, 200), atol=1e-2)
    unseen = [(g, d) for g, (i, _, d) in zip(got, rows, strict=True) if i % 3]
    assert sum(g.domain == d for g, d in unseen) > 0.97 * len(unseen)


def test_zero_target_and_infeasible(spark):
    df, labels = tables(spark, corpus())
    got = rates(df, labels, F.col("kind"), {"a": 1.0, "b": 0.0, "c": 0.0}).collect()
    assert min(r.rate for r in got) >= 0
    assert np.mean([r.rate for r in got if r.domain == "a"]) > 5 * np.mean([r.rate for r in got if r.domain != "a"])
    with pytest.raises(ValueError):
        rates(df, labels, F.col("kind"), {"a": 0.0})


def test_floor_keeps_every_row(spark):
    rows = corpus()
    df, labels = tables(spark, rows)
    settings = Settings(floor=1.0, size="floor", rounds=30)
    got = mixed(df.withColumn("tokens", F.lit(5)), labels, F.col("kind"), {"a": 0.4, "b": 0.3, "c": 0.3}, settings)
    assert got.columns == [*df.columns, "tokens"]
    count = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert set(count) == {i for i, _, _ in rows}
    c = [count[i] for i, _, d in rows if d == "c"]
    assert np.mean(c) > 2 > 1.2 > np.mean([count[i] for i, _, d in rows if d == "a"])


def test_defaults_reach_a_rare_domain(spark):
    rows = corpus(600)
    df, labels = tables(spark, rows)
    shares = {"a": 0.79, "b": 0.2, "c": 0.01}
    got = rates(df, labels, F.col("kind"), shares).collect()
    total = np.array([[r.p_a, r.p_b, r.p_c] for r in got]).T @ np.array([r.tokens * r.rate for r in got])
    assert np.allclose(total / total.sum(), list(shares.values()), rtol=5e-3)


def test_what_cannot_settle_says_so(spark):
    df, labels = tables(spark, corpus())
    classifier = learn(df, labels, F.col("kind"), ["a", "b", "c"], Settings())
    with pytest.warns(UserWarning, match="not reached"):
        mixture, _ = solve(predictions(df, classifier), classifier, {"a": 0.1, "b": 0.1, "c": 0.8}, Settings(rounds=0))
    assert not mixture.settled
    with pytest.warns(UserWarning, match="out of reach"):
        mixture, _ = solve(predictions(df, classifier), classifier, {"a": 0.1, "b": 0.1, "c": 0.8}, Settings(ceiling=1.5))
    assert mixture.settled and mixture.residuals["c"] < -0.5


def test_repeated_labels_count_once(spark):
    df, labels = tables(spark, corpus())
    many = labels.union(labels).union(labels.limit(50))
    one, other = (learn(df, x, F.col("kind"), ["a", "b", "c"], Settings()) for x in (labels, many))
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.prior, other.prior)


def test_columns_named_like_helpers(spark):
    df, labels = tables(spark, corpus(60))
    df = df.withColumns({n: F.lit("x") for n in ("__draw", "rate", "p0", "tokens")})
    got = mixed(df, labels, F.col("kind"), {"a": 0.4, "b": 0.3, "c": 0.3}, Settings(floor=1.0, size="floor", rounds=4))
    assert got.columns == df.columns and got.select("doc_id").distinct().count() == 60


def test_copies_follow_the_rates(spark):
    """The stage's rows against rates and draws, row by row."""
    df, labels = tables(spark, corpus(200))
    s = Settings(floor=1.0, ceiling=4.0, size="floor", rounds=12)
    shares = {"a": 0.4, "b": 0.3, "c": 0.3}
    rate = {r.doc_id: r.rate for r in rates(df, labels, F.col("kind"), shares, s).collect()}
    draw = {r.doc_id: ((r.h % 2**64) >> 11) * 2.0**-53 for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    got = {r.doc_id: r["count"] for r in mixed(df, labels, F.col("kind"), shares, s).groupBy("doc_id").count().collect()}
    assert got == {i: int(r) + (draw[i] < r - int(r)) for i, r in rate.items()}


def test_steps_give_the_rates(spark):
    df, labels = tables(spark, corpus())
    s = Settings(rounds=25, tolerance=1e-9, stalled=0.0)
    classifier = learn(df, labels, F.col("kind"), ["a", "b", "c"], s)
    mixture, rated = solve(predictions(df, classifier), classifier, {"a": 0.2, "b": 0.2, "c": 0.6}, s)
    rows = rated.collect()
    assert np.allclose(mixture.rates(np.array([[r.p0, r.p1, r.p2] for r in rows])), [r.rate for r in rows], atol=1e-9)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (10, None), (8, "x")], "doc_id long, kind string")
    for known in (labels, labels.limit(0)):
        got = rates(docs(spark, AWKWARD), known, F.col("kind"), {"a": 0.5, "b": 0.5}).collect()
        assert len(got) == len(AWKWARD) and all(np.isfinite(r.rate) and r.rate >= 0 for r in got)
    assert rates(docs(spark, []), labels, F.col("kind"), {"a": 1.0}).count() == 0
    assert mixed(docs(spark, []), labels, F.col("kind"), {"a": 1.0}).count() == 0
    assert isinstance(learn(docs(spark, []), labels, F.col("kind"), ["a"], Settings()), Classifier)
