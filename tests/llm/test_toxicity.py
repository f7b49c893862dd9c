import random
import zlib

import numpy as np
import pyarrow as pa
from helpers import AWKWARD, docs

from ledgerloom.llm.toxicity import PATTERNS, WIDTH, Model, Settings, _count_words, clause_match, features, folded, learn, scored, toxicity_scores, without_toxic


def match(*symbols):
    found = clause_match([(s, 1.0 if s in "IH" else 0.0) for s in symbols])
    return found and PATTERNS[found[0]]


def test_composed_transducers():
    assert match("T") is None and match() is None
    assert match("I") == "I"
    assert match("T", "I") == match("I", "T") == "It"
    assert match("T", "N", "I") == "I-t"
    assert match("N", "I", "I") == "I-"
    assert match("N", "W", "W", "W", "I") == "I-" and match("N", "W", "W", "W", "W", "I") == "I"
    assert match("N", "I", "W", "W", "W", "I") == "I"  # the stronger decides
    assert match("R", "T", "N", "H") == "H-rt"
    assert match("Q", "I", "Q") == "Ir"
    assert match("Q", "Q", "I") == "I"
    assert match("R", "H") == "Hr"


def by_rules(symbols):
    """The same clause, hit by hit."""
    hits, quoted, told = [], False, False
    for i, x in enumerate(symbols):
        if x == "Q":
            quoted, told = not quoted, False
        elif x == "R" and not quoted:
            told = True
        elif x in "IH":
            words = [y for y in symbols[:i] if y != "Q"]
            hits.append(x + ("-" if "N" in words[-4:] else "") + ("r" if quoted or told else ""))
    if not hits:
        return None
    order = ["I", "H", "Ir", "Hr", "I-", "H-", "I-r", "H-r"]
    return min(hits, key=order.index) + ("t" if "T" in symbols else "")


def test_grammar_against_rules():
    r = random.Random(3)
    for _ in range(5000):
        symbols = r.choices("IHTNRQW", [2, 1, 1, 2, 1, 1, 4], k=r.randrange(9))
        assert match(*symbols) == by_rules(symbols), symbols


def model():
    return Model({"idiot": 2.0}, {"lowei": 3.0}, np.zeros(WIDTH), 0.0)


def test_clauses():
    texts = ["You are an idiot. Nice day.", "not an idiot, loweix\nidiot", "he said: idiot", "“idiot”", "IDIOT!", "idiotic lo", "", "kill you"]
    got = [{PATTERNS[i]: round(v, 1) for i, v in enumerate(r[:-1]) if v} for r in features(model(), pa.array(texts))]
    assert got == [{"It": 2.0}, {"I-": 2.0, "I": 5.0}, {"Irt": 2.0}, {"Ir": 2.0}, {"I": 2.0}, {}, {}, {"Ht": 1.0}]
    assert np.allclose(features(model(), pa.array(texts))[:, -1], [2.5, 5.2, 0.375, 0.3, 2, 0, 0, 1.0])


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abdeghmnrst", k=r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(words, k=40)
        toxic = i % 5 == 0
        if toxic:
            w.insert(r.randrange(40), r.choice(["blorf", "quze" + r.choice(words)]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500, 8)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity_scores(docs(spark, rows, score="clash"), known).collect()
    assert len(got) == 1500
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.98 * len(held)
    kept = without_toxic(docs(spark, rows, x=1), known)
    assert kept.columns == docs(spark, rows, x=1).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_patterns_order_the_scores(spark):
    rows, labels = corpus(1500, 10)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = ["You are a blorf.", "A blorf.", "He said blorf.", "You are not a blorf.", "“blorf”", "Nothing of it."]
    found = learn(docs(spark, rows), known)
    r = scored(docs(spark, list(enumerate(more))), found).collect()
    score = {more[x.doc_id]: x.score for x in r}
    assert score["You are a blorf."] > score["A blorf."] > 0.7
    assert score["A blorf."] > score["He said blorf."] > score["You are not a blorf."] > score["Nothing of it."]
    assert 0.7 > score["He said blorf."] and score["A blorf."] > score["“blorf”"] > score["Nothing of it."]


def test_clean_texts_that_deny_or_quote_a_word_do_not_drop_it(spark):
    rows, labels = corpus(1500, 11)
    for i in range(200):
        rows.append((5000 + i, f"he is not a blorf {i} and she said blorf {i}"))
        labels.append((5000 + i, 1, 0))
    found = learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "blorf" in found.words
    got = {r.doc_id: r for r in scored(docs(spark, rows), found).collect()}
    assert not any(got[5000 + i].predicted for i in range(200))
    assert sum(got[i].predicted for i, text in rows[:1500] if "blorf" in text) > 0.95 * sum("blorf" in text for _, text in rows[:1500])


def test_every_entry_that_passes_stays(spark):
    words = [f"z{i:04d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(5500)]
    rows = [(i, " ".join(words if i % 2 else [w.replace("z", "y") for w in words])) for i in range(300)]
    labels = [(i, 1, i % 2) for i in range(300)]
    found = learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(found.words) == 5500


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(900, 9)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (learn(docs(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int"), Settings(labelled_rows=500)) for x in (labels, flipped))
    assert (a.words, a.stems, a.bias) == (b.words, b.stems, b.bias) and (a.weights == b.weights).all()


def test_awkward_rows(spark):
    known = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, None), (None, 0, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (known, known.limit(0)):
        got = toxicity_scores(docs(spark, AWKWARD), labels).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert toxicity_scores(docs(spark, []), known).count() == 0
    assert scored(docs(spark, AWKWARD), model()).count() == len(AWKWARD)


def test_scores_do_not_depend_on_the_size_of_the_lexicon():
    """Entries that a text doesn't hold change nothing, whatever the case of its letters."""
    few = {"μαλάκας": 2.0, "istanbullu": 1.5, "ışık": 1.0, "l'idiot": 2.5, "fôl": 1.0}
    stems = {"trott": 1.2, "d'imbéc": 0.8}
    many = few | {f"zz{chr(97 + i % 26)}{chr(97 + i // 26)}q": 1.0 for i in range(600)}
    texts = ["ΜΑΛΆΚΑΣ!", "μαλάκας", "you are İSTANBULLU", "ISTANBULLU", "IŞIK ışık", "L'Idiot.", "“l’idiot”", "TROTTEL, trotten", "d'imbécile", "not fôl", "clean text", "", "idiot's", "x-fôl-y 5fôl"]
    small, large = (Model(w, stems, np.ones(WIDTH), 0.0) for w in (few, many))
    got = features(small, pa.array(texts))
    assert (got == features(large, pa.array(texts))).all()
    assert (got[:2, -1] > 0).all() and got[0].tolist() == got[1].tolist() and got[3, -1] > 0 and (got[10:12] == 0).all() and got[5, -1] > 0 and got[7, -1] > 0
    none = Model(few, stems, np.ones(WIDTH), 0.0)
    words = pa.array([t for x in texts for t in x.split()])
    want = [any(s in "IH" for s, _ in none.symbol(w, f)) for w, f in zip(words.to_pylist(), folded(words).to_pylist(), strict=True)]
    assert none.hits(words).tolist() == want


def test_learned_counts_against_plain_ones(spark):
    """Documents by label in which a word stands outside negation, report and quotes in its clause."""
    rows = [
        ("you are an Idiot. fine day", 1), ("idiot idiot, day", 1), ("he said idiot. day", 0), ("not an idiot. Day!", 0), ('"idiot" day', 0), ("nice day\nidiot", 1),
        ("no. idiot day", 0), ("", 0), ("IDIOT", 1), ("idiot's day", 0),
    ]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], names=["text", "toxic"])
    got = {}
    for b in _count_words(iter([batch])):
        for r in b.to_pylist():
            old = got.get(r["word"], (0, 0))
            got[r["word"]] = (old[0] + r["toxic_docs"], old[1] + r["other_docs"])
    assert got["idiot"] == (4, 1) and got["idiot's"] == (0, 1)
    assert got["day"] == (3, 5)
