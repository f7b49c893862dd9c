import random
import re

import pytest
from compare import duck, duck_rows, kinds_differ, spark_rows
from helpers import AWKWARD, docs

from ledgerloom.llm.licenses import MOST_WORDS, NOTICES, Template, license_digests, license_spans, oracle, template_positions

PLAIN = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    own = words(text)
    found = [(i, label) for label, p in PLAIN.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(own), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


SOME = [
    (20, "CC BY cc-by CC by by cc"),
    (21, "All rights reserved. ALL RIGHTS RESERVED all rights"),
    (22, "Licensed under the GNU General Public License, general public general public license"),
    (23, "Kall rights reserved İ ccby"),
    (24, "ccé by cc\nby"),
    (25, "Released under the MIT Licence"),
    (26, "Permission is hereby granted, entirely free of charge, to any person obtaining copy of this software and its associated documentation files"),
    (27, "x " * 40_000 + "all rights reserved " + "the " * 40_000),
    (28, "all all rights all rights reserved reserved"),
    (29, "cc by cc by cc by " * 3_000),
    (None, "cc by"),
    (None, "cc by"),
]


def test_base_against_plain_words(spark):
    rows = AWKWARD + SOME
    got = license_digests(docs(spark, rows, label="clash", row=1, words="clash", template=0)).collect()
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *base(t)) for i, t in rows), key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def test_against_sql(spark, tmp_path):
    rows = AWKWARD + SOME
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duck(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    df = license_digests(docs(spark, rows))
    assert not kinds_differ(df, con, oracle())
    assert spark_rows(df) == duck_rows(con, oracle())


def test_edited_notices_are_found(spark):
    """A notice keeps its label with a word put in, left out or changed in its middle."""
    r, rows, want = random.Random(3), [], {}
    for n, t in enumerate(NOTICES):
        own = t.text.split()
        if len(own) < 12:
            continue
        at = r.randrange(4, len(own) - 4)
        for k, edited in enumerate((own[:at] + ["really"] + own[at:], own[:at] + own[at + 1 :], own[:at] + ["really"] + own[at + 1 :])):
            rows.append((10 * n + k, " ".join(["Lorem ipsum", *edited, "dolor sit"])))
            want[10 * n + k] = t.label
    got = license_spans(docs(spark, rows)).filter("NOT phrase").collect()
    assert {(s.doc_id, s.label) for s in got} >= set(want.items())
    assert all(s["first"] >= 2 and s.share >= 0.8 for s in got)


def test_scattered_words_are_no_notice(spark):
    r = random.Random(4)
    rows = []
    for n, t in enumerate(NOTICES):
        own = t.text.split()
        r.shuffle(own)
        rows.append((n, " ".join(w + " filler" for w in own)))
    assert license_spans(docs(spark, rows)).filter("NOT phrase").count() == 0


def test_whole_plan_is_native(spark):
    plan = license_digests(docs(spark, SOME))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate posexplode") == 2  # of the texts and of the templates


def test_empty_and_wrong_templates(spark):
    assert license_digests(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        template_positions(spark, (Template("short", "one"),), 2)
    with pytest.raises(ValueError):
        template_positions(spark, (Template("long", "w " * (MOST_WORDS + 1)),), 2)
