import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import docs
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture()
def tables(spark, tmp_path):
    r = random.Random(14)
    vocabulary = ["".join(r.choices("abdeghmnrst", k=r.randint(2, 7))) for _ in range(400)]
    rows, toxic = [], set()
    for i in range(400):
        w = r.choices(vocabulary, k=120)
        if i % 8 == 0:
            w.insert(5, "blorf")
            toxic.add(i)
        rows.append((i, " ".join(w)))
    clean = [x for x in rows if x[0] not in toxic]
    copies = [(1000 + k, t.replace(" ", "  ", 1)) for k, (_, t) in enumerate(clean[:30])]
    near = [(2000 + k, t + " and") for k, (_, t) in enumerate(clean[30:60])]
    docs(spark, rows + copies + near + [(3000, None), (3001, "")], license="mit").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i in toxic)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows, toxic, copies, near


def test_stages(spark, tables):
    path, rows, toxic, copies, near = tables
    at = spark.read.parquet(f"{path}/documents.parquet")
    columns = at.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    steps = []
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, path)
        at.write.parquet(f"{path}/{name}")
        at = spark.read.parquet(f"{path}/{name}")
        assert at.columns == columns
        steps.append(ids(at))
    clean = {i for i, _ in rows} - toxic
    assert set(steps[0]) == clean | {i for i, _ in copies + near} | {3000, 3001}
    longer = {i for i, _ in copies}  # of equal texts the longest original stays
    first = {i for i, _ in rows if i not in toxic}
    copied = set(sorted(first)[:30])
    assert set(steps[1]) == (first - copied) | longer | {i for i, _ in near} | {3000}
    assert set(steps[1].values()) == set(steps[2].values()) == {1}
    caught = {i for i, _ in near} - set(steps[2])
    assert caught == {i for i, _ in near} and set(steps[2]) == set(steps[1]) - caught
    assert set(steps[3]) == set(steps[2]) and set(steps[3].values()) <= {1, 2, 3, 4}
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/near_dedup").collect()}
    assert all(before[r.doc_id] == r.text for r in at.collect())  # copies are whole rows
    out = pipeline.STAGES[-1][1](spark, at, path)
    assert ids(out.filter("piece = 0")) == steps[3]
    # each copy's pieces, put together, are the library's own ids and the end
    pieces = defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append((r.piece, bytes(r.ids)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, own in pieces.items():
        whole = np.array([*tokenizer.encode(before[i] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert sorted(own) == sorted((k, whole[a : a + 8192]) for _ in range(steps[3][i]) for k, a in enumerate(range(0, len(whole), 8192)))
    whole = pipeline.run(spark, path)
    assert ids(whole.filter("piece = 0")) == steps[3] and out.columns == whole.columns
