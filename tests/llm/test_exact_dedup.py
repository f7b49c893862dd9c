import hashlib
import re

from helpers import AWKWARD, docs
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup
from ledgerloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            out.append((m[2], members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_awkward_rows(spark):
    df = docs(spark, AWKWARD, keep_id="clash", __n=1)
    assert result(exact_duplicates(df)) == brute(AWKWARD)


def test_group_over_many_partitions(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i}") for i in range(3000)]
    assert result(exact_duplicates(docs(spark, rows).repartition(5))) == brute(rows)
    kept = drop_exact_duplicates(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])
    assert kept.columns == docs(spark, rows).columns


def test_dropping_carries_rows(spark):
    df = docs(spark, AWKWARD, kept="clash")
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id) for r in got.collect())) == sorted(str(r[0]) for r in brute(AWKWARD) if r[3])


def test_columns_named_like_helpers(spark):
    names = ["__n", "__N2", "__text", "__id", "__sha", "__part", "__hash", "__edge", "__norm", "__start", "__first", "__head"]
    df = docs(spark, AWKWARD, **{n: "clash" for n in names})
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns and set(got.collect()) <= set(df.collect())
    assert sorted((str(r.doc_id) for r in got.collect())) == sorted(str(r[0]) for r in brute(AWKWARD) if r[3])
    assert result(exact_duplicates(df)) == brute(AWKWARD)


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_hash", lambda norm: F.lit(1).cast("long"))
    head = "the same beginning of thirty-two characters "
    rows = [(i, head + f"{i % 5} " + " " * (i % 3)) for i in range(300)]
    assert result(exact_duplicates(docs(spark, rows).repartition(4))) == brute(rows)
    got = drop_exact_duplicates(docs(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_empty_table(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0
    assert drop_exact_duplicates(docs(spark, [])).count() == 0
