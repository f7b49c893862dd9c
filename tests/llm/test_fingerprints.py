import hashlib
import random

import numpy as np
from helpers import AWKWARD, docs
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerloom.llm.fingerprints import ANCHORS, SPAN, Anchors, PrefixHashes, _edited_print, consecutive, edited, fingerprint, ladder, likeness, neighbour_fingerprints


def brute(rows):
    signed = lambda t: int(np.array(xxh64_intdigest(t.encode(), 42), np.uint64).view(np.int64))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = edited(t, after)
        a, b, c = fingerprint(t), fingerprint(new), fingerprint(after)
        agreed = next((k for k, (x, y) in enumerate(zip(t, new)) if x != y), min(len(t), len(new)))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c), agreed))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_awkward_rows(spark):
    assert result(neighbour_fingerprints(docs(spark, AWKWARD, fingerprint="clash"))) == brute(AWKWARD)


def test_many_parts(spark):
    r = random.Random(1)
    rows = [(i * 3, "".join(r.choices("ab cdé", k=r.randrange(200)))) for i in range(700)]
    assert result(neighbour_fingerprints(docs(spark, rows).repartition(7))) == brute(rows)


def test_rows_without_ids(spark):
    r = random.Random(5)
    rows = [(None, "".join(r.choices("ab cdé", k=r.randrange(80)))) for _ in range(400)] + [(None, "same")] * 50 + [(3, "x")]
    df = docs(spark, rows).repartition(5)
    assert result(neighbour_fingerprints(df)) == brute(rows)
    sizes = [x["count"] for x in consecutive(df)[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 200


def test_single_and_empty(spark):
    assert result(neighbour_fingerprints(docs(spark, [(5, "abcdefgh")]))) == brute([(5, "abcdefgh")])
    assert neighbour_fingerprints(docs(spark, [])).count() == 0


def test_spans_and_extensions():
    r = random.Random(2)
    t = "".join(r.choices("ab", k=400))
    u = "".join(r.choices("ab", k=300)) + t[50:250]
    h, g = PrefixHashes(t), PrefixHashes(u)
    for _ in range(500):
        i, j, n = r.randrange(400), r.randrange(500), r.randrange(12)
        assert (h.span(i, min(400, i + n)) == g.span(j, min(500, j + n))) == (t[i : i + n] == u[j : j + n])
        k = 0
        while i + k < 400 and j + k < 500 and t[i + k] == u[j + k]:
            k += 1
        assert h.common(i, g, j) == k
    assert h.common(50, g, 300) == 200


def test_blocks_of_long_texts():
    t = "abcdefghij" * 60_000
    h = PrefixHashes(t)
    assert h.span(0, 300_000) == h.span(300_000, 600_000)
    assert h.common(0, h, 10) == 599_990


def test_likeness():
    r = random.Random(3)
    t = "".join(r.choices("abcdefgh ", k=4000))
    assert likeness(fingerprint(t), fingerprint(t)) == 1.0
    assert 0.6 < likeness(fingerprint(t), fingerprint(t[:3000] + "Z" * 1000)) <= 0.85
    assert 0.8 < likeness(fingerprint(t), fingerprint(t[:2000] + "Z" + t[2001:])) <= 1.0
    assert likeness(fingerprint(t), fingerprint("Z" + t[::-1])) < 0.01
    assert likeness(fingerprint(""), fingerprint("a")) == 0.0 == likeness(fingerprint(""), fingerprint("a" * 100))
    assert ladder(40) == [*range(1, 9), 10, 12, 14, 16, 20, 24, 28, 32, 40]


def plain_share(a, b):
    """The share of the longer text's spans that the other has."""
    x, y = ({t[i : i + SPAN] for i in range(len(t) - SPAN + 1)} for t in (a, b))
    return len(x & y) / max(len(x), len(y))


def test_likeness_of_texts_changed_in_many_places():
    r = random.Random(9)
    off = []
    for _ in range(60):
        t = "".join(r.choices("abcdefgh ", k=r.randrange(500, 9000)))
        u = list("Q" + t[1:-1] + "Q")
        for _ in range(r.randrange(1, 12)):
            k = r.randrange(len(u))
            u[k : k + r.randrange(30)] = "".join(r.choices("xyz", k=r.randrange(30)))
        u = "".join(u)
        off.append(likeness(fingerprint(t), fingerprint(u)) - plain_share(t, u))
    assert max(map(abs, off)) < 0.25 and sum(map(abs, off)) / len(off) < 0.06


def test_joined_arrays_and_anchors():
    r = random.Random(10)
    for n, m in ((0, 0), (5, 3), (100, 30), (3000, 3000), (4001, 40), (30, 5000)):
        t, u = ("".join(r.choices("abé", k=k)) for k in (n, m))
        h, g = PrefixHashes(t), PrefixHashes(u)
        hashes, print_ = _edited_print(h, Anchors(h), g, Anchors(g), n // 4)
        new = edited(t, u)
        assert print_ == fingerprint(new) and [x.tolist() for x in hashes.arrays] == [x.tolist() for x in PrefixHashes(new).arrays]
    t = "".join(r.choices("ab", k=600_000))
    h = PrefixHashes(t)
    assert Anchors(h).of_first(500_000).tolist() == np.unique(h.windows(0, 500_000))[:ANCHORS].tolist()
    assert h.windows(300_000, 300_001)[0] == PrefixHashes(t[300_000 : 300_000 + SPAN]).windows(0, 1)[0]


def test_a_step_that_agrees_in_16_bits_alone():
    seen = {}
    for i in range(5000):
        text = f"{i * 7919:08d}"  # eight characters, so the last step is the whole text
        step = fingerprint(text).split(":")[2][-8:]
        if step[-4:] in seen:
            assert step != seen[step[-4:]]
            return
        seen[step[-4:]] = step
    raise AssertionError("no pair was found")
