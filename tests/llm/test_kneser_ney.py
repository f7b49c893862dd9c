import math
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, docs

from ledgerloom.llm import stores
from ledgerloom.llm.stores import mapped_counts, save_counts
from ledgerloom.llm.kneser_ney import checked_vocabulary, discounts, language_scores, log_probabilities, pack, train, unpack, words_of


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Plain:
    """The model from its formulas, in dictionaries."""

    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.b.update(zip(["</s>", *w], w, strict=False))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.before = Counter(w for _, w in self.b)
        self.after = defaultdict(Counter)
        for (u, _), k in self.b.items():
            self.after[u][min(k, 3)] += 1
        self.d2 = discounts([sum(k == j for k in self.b.values()) for j in (1, 2, 3, 4)])
        self.d1 = discounts([sum(k == j for k in self.before.values()) for j in (1, 2, 3, 4)])

    def q(self, w):
        total = len(self.b)
        rest = sum(self.d1[min(k, 3)] for k in self.before.values()) / total
        k = self.before[w]
        return (k - self.d1[min(k, 3)]) / total + rest / (self.v + 1)

    def p(self, u, w):
        if not self.n:
            return 1.0
        if not self.c[u]:
            return self.q(w)
        k = self.b[u, w]
        return (k - self.d2[min(k, 3)]) / self.c[u] + sum(self.d2[j] * n for j, n in self.after[u].items()) / self.c[u] * self.q(w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(u, x)) for u, x in zip(["</s>", *w], w, strict=False))


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    m = Plain([t for i, t in rows if not held(i)])
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((m.c[x] + 1) / (m.n + m.v + 1)) for x in w)
        out.append((i, held(i), len(w), sum(m.c[x] > 0 for x in w), m.n, base, m.score(t)))
    return sorted(out, key=lambda r: (str(r[0]), r[6]))


def same(got, want):
    got = sorted(map(tuple, got), key=lambda r: (str(r[0]), r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def some_texts(n=150):
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdé", k=r.randint(1, 3))) for _ in range(80)]
    return [(i, " ".join(r.choices(vocabulary, weights=range(80, 0, -1), k=r.randrange(60)))) for i in range(100, 100 + n)]


def test_rows_against_formulas(spark):
    rows = AWKWARD + some_texts() + [(900, " \t lead Trail \x0b\x1c "), (901, "UNSEEN zzzz qqqq")]
    same(language_scores(docs(spark, rows, score="clash").repartition(5)).collect(), brute(rows))


def test_sums_to_one(spark):
    rows = some_texts(40)
    model = train(docs(spark, rows))
    plain = Plain([t for _, t in rows])
    words = [*(w for w in plain.c if w != "</s>")][:30]
    for u in words[:3]:
        assert math.isclose(sum(plain.p(u, w) for w in plain.c) + plain.p(u, "unknown!"), 1, rel_tol=1e-9)
    counts, logs, at = log_probabilities(model, pa.array([" ".join(words)]))
    assert np.allclose(logs, [math.log10(plain.p(u, w)) for u, w in zip(["</s>", *words], [*words, "</s>"], strict=True)])
    assert counts.tolist() == [plain.c[w] for w in [*words, "</s>"]] and at.tolist() == [0, len(words) + 1]


def test_nothing_to_learn_from(spark):
    held = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    same(language_scores(docs(spark, held)).collect(), brute(held))
    assert language_scores(docs(spark, [])).count() == 0


def test_words_and_blocks():
    codes, at, hashes = words_of(pa.array(["  A b\x0ba ", "", "b"]))
    assert at.tolist() == [0, 4, 5, 7] and codes[0] == codes[2] and codes[1] == codes[5] and codes[3] == codes[4] == codes[6] == len(hashes) - 1
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (unpack(pack(x), "<u8") == x).all() and len(unpack(pack(x[:0]), "<u8")) == 0


def test_words_of_slices():
    texts = [f"Text {i} É word{i % 7}" for i in range(50)]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for a, n in ((0, 50), (20, 10), (49, 1)):
            codes, at, hashes = words_of(whole.slice(a, n))
            want = words_of(pa.array(texts[a : a + n]))
            assert (hashes[codes] == want[2][want[0]]).all() and at.tolist() == want[1].tolist()


def test_counts_beyond_32_bits(tmp_path):
    for counts in ([1, 2, 3], [1, 2**32, 5], []):
        path = str(tmp_path / f"c{len(counts)}{sum(counts)}")
        save_counts(path, np.array(counts, np.int64))
        assert mapped_counts(path, len(counts)).tolist() == counts
    checked_vocabulary(2**32 - 1)
    with pytest.raises(OverflowError):
        checked_vocabulary(2**32)


def test_files_that_cannot_be_mapped_are_held_up_to_a_bound(tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "HELD", 100)
    monkeypatch.setattr(stores, "_held", {})
    reads = []

    class Store:
        def open_input_stream(self, name):
            reads.append(name)
            return io.BytesIO(bytes(40))

    for name in ("a", "b", "a", "c", "a"):
        stores._read(Store(), name, name)
    assert reads == ["a", "b", "c", "a"] and set(stores._held) == {"c", "a"}
