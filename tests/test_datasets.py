"""Documents, pages that carry them, tables, and the stream of events."""

import glob
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import datasets, pieces
from ledgerloom.streaming import windows

DOCUMENT = {
    "transactions": [
        {"id": "a1", "date": "2031-09-03", "merchant": "Sample <shop>", "amountCents": 1250, "category": "Dining & drinks", "kind": "spend", "source": "sample-card", "flags": ["x"], "classificationEvidence": {"summary": "seen"}},
        {"id": "a2", "date": "2031-10-01", "merchant": "Sample bank", "amountCents": -50, "kind": "spend", "source": "sample-bank", "needsCategoryReview": True},
    ],
    "sources": [{"id": "sample-card", "label": "Card"}],
    "monthly": [{"month": "2031-09", "hasMainCardCoverage": True, "transactionCount": 1, "spendingCents": 1250}],
    "quarter": {}, "defaultPeriod": {"start": "2031-07-01"}, "recurring": [],
}


def test_choice_of_the_document(tmp_path):
    assert datasets.choose(str(tmp_path)) == str(tmp_path / "sample-data.json")
    (tmp_path / "sample-data.json").write_text("{}")
    assert datasets.choose(str(tmp_path)).endswith("sample-data.json")
    (tmp_path / "own-data.json").write_text("{}")
    assert datasets.choose(str(tmp_path)).endswith("own-data.json")
    assert datasets.choose(str(tmp_path), sample=True).endswith("sample-data.json")


def check(tables):
    rows = {r.id: r for r in tables["ledger"].collect()}
    assert (rows["a1"].month_idx, rows["a1"].evidence_summary, rows["a1"].needs_category_review) == (2031 * 12 + 8, "seen", None)
    assert (rows["a2"].amount_cents, rows["a2"].category, rows["a2"].needs_category_review) == (-50, None, True)
    assert [tuple(r) for r in tables["monthly"].collect()] == [(2031 * 12 + 8, True, 1, 1250)]
    assert tables["sources"].first().label == "Card"


def test_documents_and_pages(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(DOCUMENT, indent=1))
    tables = datasets.read_json(spark, str(path))
    check(tables)
    page = tmp_path / "p.html"
    page.write_text('<html><script>let a = 1;</script><script id="state" type="application/json">{}</script>\n<script type="application/json" id="data">' + json.dumps(DOCUMENT).replace("<", "\\u003c") + "</script></html>")
    check(datasets.embedded_tables(spark, str(page), "data"))
    page.write_text('<script id="data">{"transactions": []}</script>')
    with pytest.raises(ValueError, match="sources"):
        datasets.embedded_tables(spark, str(page), "data")
    path.write_text('{"transactions": []}')
    with pytest.raises(ValueError, match="monthly"):
        datasets.read_json(spark, str(path))


def test_tables_and_written_documents(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(DOCUMENT))
    datasets.write_tables(datasets.read_json(spark, str(path)), str(tmp_path / "t"))
    again = datasets.read_tables(spark, str(tmp_path / "t"))
    check(again)
    datasets.write_document(again, str(tmp_path / "out"))
    datasets.join_document(spark, str(tmp_path / "out"), str(tmp_path / "whole.json"))
    text = (tmp_path / "whole.json").read_text()
    assert text == "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*.txt")))
    assert "<" not in text and "\\u003cshop>" in text
    whole = json.loads(text)
    assert {r["id"] for r in whole["ledger"]} == {"a1", "a2"} and whole["monthly"][0]["transaction_count"] == 1
    assert all("<" not in r.json for r in datasets.safe_json(again["ledger"]).collect())


def test_documents_of_many_fragments(spark, tmp_path):
    """Tables of many parts, and an empty one, keep their rows' order; no row list is gathered."""
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "concat('<', id, '>\"') AS t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would make one of so few
    try:
        datasets.write_document({"a": rows, "none": rows.limit(0), "b": rows.filter("id % 2 = 0")}, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*.txt"))) > 1
    datasets.join_document(spark, str(tmp_path / "out"), str(tmp_path / "whole.json"))
    whole = json.loads((tmp_path / "whole.json").read_text())
    assert [r["id"] for r in whole["a"]] == list(range(5000)) and whole["none"] == [] and [r["t"] for r in whole["b"]] == [f'<{i}>"' for i in range(0, 5000, 2)]


def _put_together(rows):
    out = {}
    for r in sorted(rows):
        for k, v in json.loads(r.json).items():
            if isinstance(v, list):
                out.setdefault(k, []).extend(v)
            else:
                assert k not in out
                out[k] = v
    return out


NESTED = {
    "n": 3, "transactions": [{"id": i, "t": 'x}"{[\\' * (i % 5), "e": {"s": [1, {"q": "]"}]}} for i in range(900)],
    "quarter": {"a": {"b": 1}, "m": [{"z": 1}]}, 'odd "name"': [{"x": {}}, {"x": 2}], "empty": [], "sources": [{"id": "a"}], "last": "}",
}


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_are_read_in_splits(spark, tmp_path, indent):
    """Cut anywhere, in strings, escapes and nested values, the parts put together are the document, in its order."""
    path = tmp_path / "d.json"
    path.write_text(json.dumps(NESTED, indent=indent) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        splits = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
        got = pieces.parts(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 5 and _put_together(got) == NESTED
    page = tmp_path / "p.html"
    page.write_text("<style>a { b: 'c' }</style>\n<script id='data'>" + json.dumps(NESTED, indent=indent) + "\n</script><script>if (a) { b(\"}\") }</script>")
    assert _put_together(pieces.parts(spark, str(page), "data").collect()) == NESTED
    assert pieces.parts(spark, str(page), "other").collect() == []


def test_parts_are_put_together_once(spark, tmp_path):
    """What is read of a document's parts numbers and groups no pieces again."""
    path = tmp_path / "d.json"
    path.write_text(json.dumps(NESTED))
    plan = pieces.parts(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "grouped" in plan


def test_documents_that_are_no_documents(spark, tmp_path):
    path = tmp_path / "d.json"
    for text, says in (('{"a": [{"b": 1}', "does not end"), ('{"a": "}', "does not end"), ('{"a": [{"b": 1}, 5, {"b": 2}]}', "mixes"), ("no {} json }", "no JSON")):
        path.write_text(text)
        with pytest.raises(Exception, match=says):
            pieces.parts(spark, str(path)).collect()
    path.write_text('{} {"a": [{"b": 1}]}')  # what follows is left out
    assert _put_together(pieces.parts(spark, str(path)).collect()) == {}
    path.write_text("")
    assert pieces.parts(spark, str(path)).collect() == []


def test_fragments_are_read_as_they_are(spark, tmp_path):
    """The files of a folder are one document, wherever its rows and arrays are cut."""
    rows = spark.range(0, 3000, 1, 7).selectExpr("id", "struct(id % 7 AS m, concat('}', id, '\"') AS t) AS e")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        datasets.write_document({"a": rows, "none": rows.limit(0), "b": rows.filter("id % 2 = 0")}, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = _put_together(pieces.parts(spark, str(tmp_path / "out")).collect())
    assert len(list((tmp_path / "out").glob("part-*.txt"))) > 1
    assert got == {"a": [{"id": i, "e": {"m": i % 7, "t": f'}}{i}"'}} for i in range(3000)], "none": [], "b": [{"id": i, "e": {"m": i % 7, "t": f'}}{i}"'}} for i in range(0, 3000, 2)]}
    folder = tmp_path / "cut"
    folder.mkdir()
    whole = '{"a":[{"x":1},|{"x":2}|,\n{"x":|3}\n|],"b":[|{"y":[{"z":1}|]}],"c":4}'
    for i, text in enumerate(whole.split("|")):
        (folder / f"part-{i}").write_text(text)
    assert _put_together(pieces.parts(spark, str(folder)).collect()) == json.loads(whole.replace("|", ""))


def _begun(spark):
    """How many pieces the last document read had summed and joined, with their texts."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return spark.read.parquet(max(glob.glob(f"{root}/*-begun"), key=os.path.getmtime)).count()


def test_whole_rows_stay_where_they_are_read(spark, tmp_path):
    """Of rows without objects of their own no text is shuffled or staged again; rows with them, between, are put together."""
    rows = [{"id": i, "t": 'a"\\[' * (i % 3), "f": ["x"] * (i % 2)} | ({"e": {"z": [{"y": i}, {"y": 1}, {"y": 2}]}} if i % 3000 == 7 else {}) for i in range(10_000)]
    document = {"n": {"a": 1}, "rows": rows, "none": [], "more": rows[:5000], "last": {"b": [{"c": 1}, {"c": 2}, {"c": 3}]}}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = pieces.parts(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert _put_together(got) == document and len(got) > 14_900
    assert _begun(spark) < 100


def test_strings_that_look_like_rows(spark, tmp_path):
    document = {"t": [{"a": i, "b": "x},{1},{2},{[3},{4" * (i % 2)} for i in range(50)], "u": "},{5},{6}", "v": [{"a": 1}, {"a": 2}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document))
    assert _put_together(pieces.parts(spark, str(path)).collect()) == document


def test_packed_fragments(spark, tmp_path):
    """Packed files are read as the same text unpacked, whatever they end in; a table's first partition may be empty."""
    rows = spark.range(0, 3000, 1, 7).selectExpr("id", "concat('<}', id) AS t").filter("id >= 1000")
    datasets.write_document({"a": rows, "none": rows.limit(0), "b": rows.filter("id < 1200")}, str(tmp_path / "out"), "gzip")
    assert len(list((tmp_path / "out").glob("part-*.gz"))) > 5
    want = {"a": [{"id": i, "t": f"<}}{i}"} for i in range(1000, 3000)], "none": [], "b": [{"id": i, "t": f"<}}{i}"} for i in range(1000, 1200)]}
    assert _put_together(pieces.parts(spark, str(tmp_path / "out")).collect()) == want
    datasets.join_document(spark, str(tmp_path / "out"), str(tmp_path / "whole.json"))
    assert json.loads((tmp_path / "whole.json").read_text()) == want
    folder = tmp_path / "cut"
    folder.mkdir()
    whole = '{"a":[{"x":1},|{"x":2}|,\n{"x":|3}\n|,{"x":|\n|4},{"x":5}|],"b":[|{"y":[{"z":1}|]}],"c":4}'
    for i, text in enumerate(whole.split("|")):
        (folder / f"part-{i}.gz").write_bytes(gzip.compress(text.encode()))
    assert _put_together(pieces.parts(spark, str(folder)).collect()) == json.loads(whole.replace("|", ""))
    (tmp_path / "short.gz").write_bytes(gzip.compress(b'{"a": [{"b": 1}, {"b": 2'))
    with pytest.raises(ValueError, match="does not end"):
        pieces.parts(spark, str(tmp_path / "short.gz"))


def test_stream_gives_the_batch_sums(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    sums = windows.stream(spark, str(tmp_path / "in"), events.schema, late="3650 days")
    running = sums.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    want = windows.windowed(events)
    assert {tuple(r) for r in spark.table("sums").select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_late_and_repeated_events(spark, tmp_path):
    """Repeats within the watermark count once; totals kept by batch, and a batch run again, equal those of the batch query."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [events.filter(f"event_id % 3 = {k}") for k in range(3)]
    parts[2] = parts[2].union(parts[0].limit(40))  # repeats, in a later batch than their firsts
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # from the start again: the same batches replace themselves
        running = windows.keep_monthly(windows.once(arriving, "3650 days"), str(tmp_path / "kept"), str(tmp_path / f"c{_}"))
        running.processAllAvailable()
        running.stop()
        got = {tuple(r) for r in windows.kept_monthly(spark, str(tmp_path / "kept")).collect()}
        assert got == {tuple(r) for r in windows.monthly(events).collect()}
    assert len(list((tmp_path / "kept").glob("batch=*"))) >= 3


def test_sessions_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "3650 days")
    running = windows.sessions(arriving).writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    want = windows.sessions(events)
    assert {tuple(r) for r in spark.table("sessions").select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
