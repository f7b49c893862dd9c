import random
import re
import zlib
from collections import Counter

from helpers import AWKWARD, docs

from ledgerloom.llm.spelling import Rule, counted_words, near_pairs, spelling_variants, variants

KEY = lambda r: [(x is None, str(x)) for x in r]


def plain_words(rows, rule):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % rule.every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += len(run) >= rule.length
    return {w: n for w, n in out.items() if n >= rule.least}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(words, rule):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= rule.ratio * words[w] else None
    rows = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=KEY)


def some_words(n=400, letters="abcé", lengths=(6, 10)):
    r = random.Random(5)
    words = {}
    while len(words) < n:
        w = "".join(r.choices(letters, k=r.randint(*lengths)))
        words[w] = r.choice([5, 6, 30, 200, 1500])
    return words


def test_words_against_plain_counts(spark):
    r = random.Random(2)
    vocabulary = [*some_words(60), "Straße", "ÀÉÎõüÿ", "naïveté", "TheTheThe"]
    rows = AWKWARD + [(i, " ".join(r.choices(vocabulary, k=200)) + "×÷ don't œuvres") for i in range(40)] + [(None, "Straße " * 9)] * 2
    rule = Rule(every=7)
    got = {x.word: x.n for x in counted_words(docs(spark, rows, word="clash", n=1), rule).collect()}
    assert got == plain_words(rows, rule)
    out = spelling_variants(docs(spark, rows), rule)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect()), key=KEY) == brute(plain_words(rows, rule), rule)


def test_groups_against_brute_force(spark):
    """Dense words, so that blocks of any bound are subdivided down to one open code point."""
    words = some_words() | {w: n for w, n in zip(["aaaaaa", "aaaaaaa", "aaaaaaaa", "abaaaa", "aabaaa"], [5, 25, 125, 6, 6], strict=True)}
    words |= {"x" * 5000: 5, "x" * 4999 + "y": 50, "x" * 4999: 300, "q" + "x" * 4999: 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute(words, Rule())
    for most in (1, 4, 64, 10_000):
        assert sorted(map(tuple, variants(df, Rule(most=most)).collect()), key=KEY) == want


def test_each_pair_once_and_blocks_are_bounded(spark):
    """A third of all words shares its first half and its last quarter; pairs compared stay far below the square."""
    r = random.Random(8)
    words = {"prefix" + "".join(r.choices("abcdefghijklmnop", k=5)) + "end": 5 for _ in range(3000)} | {"".join(r.choices("abcdefgh", k=9)): 5 for _ in range(3000)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [tuple(sorted((p.word, p.near))) for t in near_pairs(df, Rule(most=32)) for p in t.collect()]
    assert len(pairs) == len(set(pairs))
    cut = {}
    for w in words:
        for i in range(len(w) + 1):
            for k in {w[:i] + "?" + w[i:], w[:i] + "?" + w[i + 1 :]} if i < len(w) else {w + "?"}:
                cut.setdefault(k, set()).add(w)
    want = {(a, b) for own in cut.values() for a in own for b in own if a < b and one_edit(a, b)}
    assert set(pairs) == want


def test_empty(spark):
    assert spelling_variants(docs(spark, [])).count() == 0
