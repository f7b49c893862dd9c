import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from helpers import AWKWARD, docs
from tokenizers import Tokenizer

from ledgerloom.llm.packing import packed, plan, sequences

WORDS = P.path("word_bpe_49k.json")


def by_item(lengths, capacity):
    """The same rule, item by item: sequences as sorted lists of lengths."""
    left = sorted(lengths, reverse=True)
    bins = []
    large = [x for x in left if 3 * x > capacity]
    while large:
        a = large.pop(0)
        mate = next((i for i, x in enumerate(large) if a + x <= capacity), None)
        bins.append([a] if mate is None else [a, large.pop(mate)])
    for x in left:
        if 3 * x <= capacity:
            fits = [b for b in bins if capacity - sum(b) >= x]
            if fits:
                max(fits, key=sum).append(x)
            else:
                bins.append([x])
    return bins


def test_plan_against_item_by_item():
    r = random.Random(4)
    for _ in range(300):
        c = r.choice([10, 37, 100])
        lengths = [r.randint(1, c) for _ in range(r.randrange(60))]
        runs = plan(Counter(lengths), c)
        held = Counter()
        for n, content in runs:
            assert sum(k * t for k, t in content) <= c
            for k, t in content:
                held[k] += n * t
        assert held == Counter(lengths)
        assert sum(n for n, _ in runs) == len(by_item(lengths, c))


def test_large_counts_stay_small():
    runs = plan({k: 10**9 + k for k in range(1, 2049)}, 2048)
    total = sum(k * (10**9 + k) for k in range(1, 2049))
    assert len(runs) < 3 * 2048 and sum(n for n, _ in runs) < 1.01 * total / 2048


def check(rows, got):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) == len(by_item([r.length for r in got], 2048))


def test_awkward_rows(spark):
    rows = AWKWARD + [(50, "word " * 5000), (51, "w " * 2047), (52, "w " * 2048)]
    check(rows, packed(docs(spark, rows, length="clash"), WORDS).collect())
    assert packed(docs(spark, []), WORDS).count() == 0


def test_many(spark):
    r = random.Random(5)
    rows = [(i, "word " * r.choice([3, 3, 3, r.randrange(3000)])) for i in range(600)]
    check(rows, packed(docs(spark, rows).repartition(6), WORDS).collect())


def test_sequences_hold_the_ids(spark):
    rows = AWKWARD + [(50, "word " * 5000), (51, "w " * 2047)]
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    want = Counter((i, *t.encode(text or "", add_special_tokens=False).ids, 0) for i, text in rows if i not in (None, 8))
    texts, held = {}, {}
    for r in sequences(docs(spark, rows), WORDS).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        texts.setdefault(r.doc_id, {})[r.start] = ids.tolist()
        held.setdefault(r.sequence_id, {})[r.offset] = ids
    got = Counter((i, *(x for s in sorted(parts) for x in parts[s])) for i, parts in texts.items() if i not in (None, 8))
    assert got == want
    for parts in held.values():
        assert len(np.concatenate([parts[k] for k in sorted(parts)])) <= 2048


def test_the_pipeline_ends_in_sequences(spark):
    import corpus_pipeline

    out = corpus_pipeline.pack(spark, docs(spark, AWKWARD), "")
    assert all(len(r.ids) == 4 * r.length for r in out.collect())
