import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, docs

from ledgerloom.llm import search
from ledgerloom.llm.search import ranked_search, term_weight, terms


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k):
    own = [(i, Counter(plain_terms(t))) for i, t in rows]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    query = {}
    for i, t in items:
        query.setdefault(i, Counter()).update(plain_terms(t))
    out = []
    for item, q in query.items():
        scored = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in q.items() if c[t])
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def some_rows():
    r = random.Random(13)
    vocabulary = ["".join(r.choices("abcdeé1", k=4)) for _ in range(120)]
    rows = AWKWARD + [(1000 - i, " ".join(r.choices(vocabulary, k=r.randrange(1, 60)))) for i in range(300)]
    rows += [(3000 + i, "same Words, same_words") for i in range(50)] + [(None, "same words"), (None, "same words")]
    items = [(i, " ".join(r.choices(vocabulary, k=12))) for i in range(8)] + [(20, "SAME words same"), (21, None), (22, "-"), (23, "absent"), (24, "a"), (24, "a b")]
    return rows, items


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_terms():
    for t in ["", "Ünï-CODE_x9\x00a\x7fb", "a\x85b c", "😀x İ"]:
        assert [x.decode() for x in terms(t.encode())] == plain_terms(t)


@pytest.mark.parametrize("block", [7, 8192])
def test_ranks_against_brute_force(spark, block):
    rows, items = some_rows()
    got = ranked_search(docs(spark, rows, score="clash", term="clash"), items_of(spark, items), k=20, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, items, 20)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rows, items = some_rows()
    monkeypatch.setattr(search, "MOST_TERMS", 20)
    assert sorted(map(tuple, ranked_search(docs(spark, rows), items_of(spark, items), k=5).collect())) == brute(rows, items, 5)
    monkeypatch.setattr(search, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        ranked_search(docs(spark, rows), items_of(spark, items))


def test_weights_are_those_of_the_plain_rule():
    n = 12_345
    df = np.arange(1, n)
    assert term_weight(n, df).tolist() == [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]


def test_empty(spark):
    _, items = some_rows()
    assert ranked_search(docs(spark, []), items_of(spark, items)).count() == 0
    assert ranked_search(docs(spark, AWKWARD), items_of(spark, [])).count() == 0
