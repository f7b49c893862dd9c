import random
import re

import xxhash
from helpers import AWKWARD, docs

from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates


def plain(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def brute(rows, words):
    fps = [(i, plain(t, words)) for i, t in rows]
    root = classes(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=str)


def some_texts():
    r = random.Random(10)
    vocabulary = ["".join(r.choices("abcdefgé", k=4)) for _ in range(200)]
    base = [r.choices(vocabulary, k=300) for _ in range(12)]
    rows = []
    for i in range(240):
        w = list(base[i % 12])
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((1000 - i, " ".join(w)))
    return rows


def test_fingerprints():
    for t in ["", "One", "one TWO", "Ünï a\x0bb\x1cc", "a b c d e f g"] + [t for _, t in some_texts()[:5]]:
        assert fingerprint(t.encode(), 3) == plain(t, 3)


def test_rows_against_brute_force(spark):
    rows = AWKWARD + some_texts() + [(2000, "x y"), (2001, "X  y"), (None, "only null")]
    got = sorted(map(tuple, near_duplicates(docs(spark, rows, fingerprint="clash"), 3).collect()), key=str)
    assert got == brute(rows, 3)
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})


def test_all_links_are_found(spark):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = {0, 2**64 - 1}
    for b in base:
        prints.add(b)
        for _ in range(15):
            prints.add(b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {(min(x, y), max(x, y)) for a in prints for b in prints if 0 < (a ^ b).bit_count() <= 3 for x, y in [(signed(a), signed(b))]}
    got = links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()
    assert {tuple(e) for e in got} == want


def test_one_of_each_component_stays(spark):
    rows = AWKWARD + some_texts()
    df = docs(spark, rows, component_id="clash")
    kept = drop_near_duplicates(df, 3)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute(rows, 3)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(want)
    assert drop_near_duplicates(docs(spark, [(None, "a b"), (None, "a b")]), 3).count() == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, k) for k in range(501, 700)] + [(900, 901)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{k: 500 for k in range(501, 700)}, 901: 900}


def test_empty(spark):
    assert near_duplicates(docs(spark, []), 3).count() == 0
    assert drop_near_duplicates(docs(spark, []), 3).count() == 0


def test_columns_named_like_helpers(spark):
    df = docs(spark, AWKWARD, **{n: "clash" for n in ("__fp", "__print", "__id", "__k", "__null", "fp")})
    got = drop_near_duplicates(df)
    plain = drop_near_duplicates(docs(spark, AWKWARD))
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in plain.collect())
