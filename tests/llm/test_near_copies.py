import random

from helpers import AWKWARD, docs
from pyspark.sql import functions as F

from ledgerloom.llm import near_copies, simhash
from ledgerloom.llm.near_copies import _linked, _rare_pairs, drop_near_copies, similarity


def shingles(text):
    own = (text or "").lower().split()
    return {" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def brute(rows):
    """The ids that stay, and how many pairs reach 0.8."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if len(x & y) / len(x | y) >= 0.8:
                pairs += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted(least.values()), pairs


def edited_copies():
    """Texts of 60 to 300 words and copies with a few words changed: similarities around 0.8."""
    r = random.Random(20)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows = []
    for k in range(120):
        own = r.choices(words, k=r.randint(60, 300))
        rows.append((10 * k, " ".join(own)))
        for c in range(r.randrange(1, 4)):
            new = list(own)
            for _ in range(max(1, round(len(own) * r.choice([0.005, 0.01, 0.02, 0.025, 0.04])))):
                new[r.randrange(len(new))] = r.choice(words)
            rows.append((10 * k + 1 + c, " ".join(new)))
    return rows


def test_all_pairs_of_brute_force(spark):
    rows = edited_copies()
    want, pairs = brute(rows)
    assert pairs > 100 and len(want) > 130
    df = docs(spark, rows, __n="clash").repartition(5)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_rare_pairs_lose_none(spark):
    """Of all pairs of different texts, those that reach the bound are among the rare pairs."""
    rows = edited_copies()[:220]
    nodes = spark.createDataFrame([(i, i, t) for i, t in rows], "node long, root long, text string")
    got = {(r.u, r.v) for r in _rare_pairs(nodes, 5, 0.8).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert want and want <= got and len(got) < 3 * len(want) + 20


def test_a_large_group_below_the_bound_gives_few_pairs(spark):
    r = random.Random(21)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    own = r.choices(words, k=200)
    rows = [(0, " ".join(own))]
    for k in range(1, 300):
        new = list(own)
        for _ in range(r.randrange(2, 14)):
            new[r.randrange(len(new))] = r.choice(words)
        rows.append((k, " ".join(new)))
    nodes = spark.createDataFrame([(i, i, t) for i, t in rows if i and len(shingles(t) & shingles(rows[0][1])) / len(shingles(t) | shingles(rows[0][1])) < 0.8], "node long, root long, text string")
    n = nodes.count()
    assert n > 100 and _rare_pairs(nodes, 5, 0.8).count() < n
    assert sorted(r.doc_id for r in drop_near_copies(docs(spark, rows)).collect()) == brute(rows)[0]


def test_fingerprints_within_three_bits_are_one_group(spark):
    rows = edited_copies()
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    nodes = spark.createDataFrame([(i, p - (p >> 63 << 64)) for i, p in prints.items()], "node long, fp long")
    keys = {r.node: r.key for r in _linked(nodes).collect()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert len(near) > 10 and all(keys[a] == keys[b] for a, b in near)
    assert len(keys) == len(rows) and len(set(keys.values())) > len(rows) - len(near) - 1


def test_linked_fingerprints_are_candidates_without_a_band(spark, monkeypatch):
    """Where bands don't agree, copies within three bits are found, and those below the bound stay."""
    own = [f"w{i}" for i in range(400)]
    changed = lambda k: " ".join("x" if i == k else w for i, w in enumerate(own))
    rows = [(1, " ".join(own)), (2, changed(7)), (3, "a b c d e f"), (4, "a b c d e g")]
    near = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    assert (near[1] ^ near[2]).bit_count() <= 3
    made = near_copies._prints
    monkeypatch.setattr(near_copies, "_prints", lambda r, w: made(r, w).withColumn("bands", F.array(F.col("doc_id"))))
    assert sorted(r.doc_id for r in drop_near_copies(docs(spark, rows)).collect()) == [1, 3, 4]


def test_the_stage_finds_them(spark):
    import corpus_pipeline

    rows = edited_copies()
    got = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)[0]


def test_awkward_rows(spark):
    got = sorted((r.doc_id for r in drop_near_copies(docs(spark, AWKWARD)).collect()), key=str)
    assert got == [1, 10, 11, 2, 3, 6, 7, 8]  # 11 has a no-break space
    assert drop_near_copies(docs(spark, [(None, "a b"), (None, "a b")])).count() == 1
    assert drop_near_copies(docs(spark, [])).count() == 0


def test_similarity():
    assert similarity(b"a b c d e f", b"A b  c d e f", 5) == 1.0
    assert similarity(b"a b c d e f", b"a b c d e g", 5) == 1 / 3
    assert similarity(b"", b" \n", 5) == 1.0 and similarity(b"", b"x", 5) == 0.0
