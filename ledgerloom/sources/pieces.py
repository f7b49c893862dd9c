"""One large JSON document, read by many tasks.

The text source cuts files at closing braces, wherever a split begins, so a document's pieces
are read by as many tasks as it has splits, or compressed files. What stands before a piece decides what it means:
whether it begins in a string, and how deep in braces and brackets. Each split sums its pieces'
effects for either beginning, the splits' sums (a row for each split) are added up in order, and so every
piece knows where it begins. Pieces between two places where an object of the document's own arrays
or fields ends are joined, and become a small document of that part alone.

A row without objects of its own is a piece by itself and leaves the depth as it was. So only the other pieces are summed,
without their texts; rows that lie between two of them, straight in an array of the document, are parts as they
are and stay where they were read. The texts of all the rest are shuffled and joined.

Cases: strings may hold braces, brackets, quotes and escapes; rows may span splits and files; the
files of a folder are one document, in the order of their numbers, cut outside of strings. Rows must be objects straight in an array of the
document: one that mixes objects with other values is an error, and a field that
holds rows any deeper is one part, however long. A document that ends too early is an error; what follows it is ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import shared_path

_CUT = "}"
_TEXTS = r'[^"{\[\]]++|"(?:[^"\\]++|\\.)*+"'
#: A row that is one piece: an object behind a comma, of values that are no objects or arrays, or arrays of such.
_ROW = rf"(?s)\A\s*+,\s*+\{{(?:{_TEXTS}|\[(?:{_TEXTS})*+\])*+\z"
_PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)\z"
#: Pieces are looked up in stretches by their number without these bits, and numbered below their split's with the others.
_CHUNK, _PLACE = 12, 33
_SUMS = ["quotes", "b0", "k0", "b1", "k1"]


def _depths(text: Column) -> tuple[Column, Column]:
    """How much deeper a text without escapes, begun outside of strings, ends in braces and in brackets."""
    bare = F.regexp_replace(text, r'"[^"]*("|\z)', "")

    def count(c: str) -> Column:
        return F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))

    return count("{"), count("[") - count("]")


def _summed(pieces: DataFrame) -> DataFrame:
    """Adds pieces' effects without the brace behind them: `quotes`, an odd number of them or not, and how much deeper they
    end in braces and brackets, begun outside of strings (b0, k0) or in one (b1, k1).
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    effects = [(F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2, *_depths(bare), *_depths(F.concat(F.lit('"'), bare))]
    return pieces.withColumns(dict(zip(_SUMS, effects)))


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, size, bytes, blank, row, value), of a row for each closing brace: what stands before it, and whether it has a row's shape; in the order of file, block and at."""
    own = F.col("_metadata")
    read = spark.read.option("lineSep", _CUT).text(path).select(own["file_path"].alias("path"), own["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), own["file_size"].alias("size"), "value")
    # parts' names have numbers of growing length
    file = F.struct(F.length("path").alias("length"), F.col("path"))
    blank = F.col("value").rlike(r"\A\s*\z")
    return read.select(file.alias("file"), "block", "at", "size", F.octet_length("value").alias("bytes"), blank.alias("blank"), F.col("value").rlike(_ROW).alias("row"), "value")


def _told(pieces: DataFrame, path: str) -> DataFrame:
    """Pieces with `cut`, whether a brace follows, and `behind`, whether one comes before."""
    spark = pieces.sparkSession
    # a file's last piece has no brace behind it unless the lengths, with a brace for each piece, are the file's
    first, last = F.min(F.struct("block", "first")).alias("first"), F.max(F.struct("block", "last", "ends_blank")).alias("last")
    ends = pieces.groupBy("file", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max(F.when(F.col("blank"), F.col("at"))).alias("blank"), F.sum(F.col("bytes") + 1).alias("bytes"), F.max("size").alias("size"))
    ends = ends.withColumn("ends_blank", F.coalesce(F.col("blank") == F.col("last"), F.lit(False)))
    files = ends.groupBy("file").agg(first, last, F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    uncut = F.col("bytes") > F.col("size")
    if packed := [f for f in spark.read.text(path).inputFiles() if re.search(_PACKED.replace("\\z", "$"), f)]:
        # a packed file's length is not known: it ends in a brace if pieces cut at opening braces are longer by one
        other = spark.read.option("lineSep", "{").text(packed).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(F.octet_length("value") + 1).alias("other"))
        files = files.join(other, F.col("file.path") == F.col("path"), "left").drop("path")
        uncut = F.when(F.col("file.path").rlike(_PACKED), F.col("bytes") >= F.col("other")).otherwise(uncut)
    files = files.select("file", "first", "last", uncut.alias("uncut"), F.col("last.ends_blank").alias("ends_blank"))
    # a row for each file; one that is all blank is as if it were not there
    filled = F.when(~(F.col("uncut") & F.col("ends_blank") & (F.col("first.block") == F.col("last.block")) & (F.col("first.first") == F.col("last.last"))), F.col("uncut") & ~F.col("ends_blank"))
    goes_on = F.last(filled, ignorenulls=True).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = _staged(files.select(F.col("file").alias("__file"), "first", "last", "uncut", "ends_blank", F.coalesce(goes_on, F.lit(False)).alias("goes_on")), "files")
    found = pieces.join(F.broadcast(files), F.col("file") == F.col("__file"))  # a row for each file: no piece moves
    is_first = (F.col("block") == F.col("first.block")) & (F.col("at") == F.col("first.first"))
    is_last = F.col("uncut") & (F.col("block") == F.col("last.block")) & (F.col("at") == F.col("last.last"))
    told = found.filter(~(is_last & F.col("ends_blank"))).withColumns({"cut": ~is_last, "behind": ~(is_first & F.col("goes_on"))})
    return told.select("file", "block", "at", "value", "cut", "behind", "row")


def _between(pieces: DataFrame, element: str) -> DataFrame:
    """Those pieces of a page that lie in its script element of this id, without the tags: the first such element."""
    opening = f"(?s)<script[^>]*\\bid=[\"']{element}[\"'][^>]*>"
    place = F.struct("file", "block", "at")
    found = pieces.filter(F.col("value").rlike(opening)).agg(F.min(place).alias("p"))
    first = pieces.join(found, place >= F.col("p")).withColumn("value", F.when(place == F.col("p"), F.regexp_replace("value", f"(?s)\\A.*?{opening}", "")).otherwise(F.col("value")))
    ending = first.filter(F.contains("value", F.lit("</script>"))).agg(F.min(place).alias("e"))
    inside = first.drop("p").join(ending, F.col("e").isNull() | (place <= F.col("e")))
    last = place == F.col("e")
    own = F.when(last, F.substring_index("value", "</script>", 1)).otherwise(F.col("value"))
    return inside.select("file", "block", "at", own.alias("value"), (F.col("cut") & F.coalesce(~last, F.lit(True))).alias("cut"), "behind")


def _begun(rows: DataFrame) -> DataFrame:
    """Adds in which state each piece begins: `quoted`, and `braces` and `brackets` around it."""
    kept = rows.columns
    for begun in (0, 1):
        # a piece's effects, begun outside of strings or in one; a brace behind it closes unless it ends in a string
        rows = rows.withColumns({f"own_b{begun}": F.col(f"b{begun}") - (F.col("cut") & ((F.col("quotes") + begun) % 2 == 0)).cast("int"), f"own_k{begun}": F.col(f"k{begun}")})
    rows = rows.drop(*_SUMS[1:])
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("odd", F.coalesce(F.sum("quotes").over(inside), F.lit(0)) % 2)
    for begun in (0, 1):
        # the split begins in a string or doesn't, and the piece likewise or not, by the quotes between
        quoted = (F.col("odd") + begun) % 2 == 1
        rows = rows.withColumns({f"{c}{begun}": F.when(quoted, F.col(f"own_{c}1")).otherwise(F.col(f"own_{c}0")) for c in "bk"})
    sums = ["b0", "k0", "b1", "k1"]
    rows = rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    blocks = rows.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), *[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    blocks = blocks.withColumn("p", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    taken = blocks.select(F.col("file").alias("__file"), F.col("block").alias("__block"), "p", *[F.when(F.col("p") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in "bk"])
    starts = taken.select("__file", "__block", "p", *[F.coalesce(F.sum(c).over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(c) for c in "bk"])
    joined = rows.join(F.broadcast(starts), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))

    def of(c: str) -> Column:
        return F.when(F.col("p") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))

    depths = {"braces": F.col("b") + of("before_b"), "brackets": F.col("k") + of("before_k"), "braces_after": F.col("b") + of("before_b") + of("b"), "brackets_after": F.col("k") + of("before_k") + of("k")}
    return joined.select(*[c for c in kept if c not in _SUMS[1:]], ((F.col("odd") + F.col("p")) % 2 == 1).alias("quoted"), *[v.alias(n) for n, v in depths.items()])


def _running(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Adds n_<flag>: how many rows up to this one, itself included, have each flag."""
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    blocks = rows.groupBy("file", "block").agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in flags])
    bases = blocks.select(F.col("file").alias("__file"), F.col("block").alias("__block"), *[F.coalesce(F.sum(f).over(earlier), F.lit(0)).alias(f"__{f}") for f in flags])
    counted = rows.withColumns({f"n_{f}": F.sum(F.col(f).cast("long")).over(own) for f in flags})
    joined = counted.join(F.broadcast(bases), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return joined.select(*rows.columns, *[(F.col(f"n_{f}") + F.col(f"__{f}")).alias(f"n_{f}") for f in flags])


def _checked(json: Column) -> Column:
    wrong = F.raise_error(F.lit("an array of the document mixes objects with other values, or it is no JSON"))
    return F.when(F.col("opens") & F.json_object_keys(json).isNull(), wrong).otherwise(json)  # filters may be tried on parts that do not open


def _stretches(others: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, block, rank, lo, hi, and how a stretch begins): pieces that are no rows, each with those rows that follow it: behind lo and before hi.

    A split begins with a stretch of its own, behind a mark before its first piece.
    """
    rows = _begun(others.drop("value").unionByName(_marks(splits).drop("value")))
    after = F.lead("at").over(Window.partitionBy("file", "block").orderBy("at"))
    in_string = (F.col("quoted").cast("int") + F.col("quotes")) % 2 == 1
    own = rows.select("file", "block", F.col("at").alias("lo"), after.alias("next"), in_string.alias("in_string"), F.col("braces_after").alias("braces"), F.col("brackets_after").alias("brackets"))
    return _ranked(own, splits).withColumn("hi", F.coalesce("next", F.col("last") + 1)).drop("next", "last")


def _ranked(rows: DataFrame, splits: DataFrame) -> DataFrame:
    own = splits.select(F.col("file").alias("__file"), F.col("block").alias("__block"), "rank", "last")
    return rows.join(F.broadcast(own), (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).drop("__file", "__block")  # a row for each split


def _marks(splits: DataFrame) -> DataFrame:
    """An empty piece before the first one of each split."""
    no, zero = F.lit(False), F.lit(0)
    return splits.select("file", "block", (F.col("first") - 1).alias("at"), F.lit("").alias("value"), no.alias("cut"), no.alias("behind"), no.alias("row"), *[zero.alias(c) for c in _SUMS], F.lit(True).alias("mark"))


def _in_chunks(stretches: DataFrame, *columns: str) -> DataFrame:
    chunks = F.sequence(F.shiftright(F.col("lo") + 1, _CHUNK), F.shiftright(F.col("hi") - 1, _CHUNK))
    return stretches.select(F.explode(chunks).alias("chunk"), "lo", "hi", *columns)


def _inside() -> Column:
    """Whether a piece lies in a stretch."""
    return (F.shiftright("at", _CHUNK) == F.col("chunk")) & (F.col("at") > F.col("lo")) & (F.col("at") < F.col("hi"))


_PARTS = "part long, opens boolean, name string, json string"


def _under(name: Column, rows: Column) -> Column:
    """Rows as a document that has them in its one field."""
    return F.concat(F.lit('{"'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('":['), rows)


def parts(spark: SparkSession, path: str, element: str | None = None) -> DataFrame:
    """The document at a path, or in a page's script element, as small documents: (part, opens, name, json).

    Each part has the fields of a stretch of the document; an array's parts each have some of its rows, in order of `part`. Where
    `opens`, the part begins its last field; elsewhere `name` is its one field. Raises where the document doesn't end.
    """
    texts = _staged(_raw(spark, path), "pieces")
    pieces = _told(texts, path)
    if element is not None:
        pieces = texts = _staged(_between(pieces, element).withColumn("row", F.col("value").rlike(_ROW)), "script")
    splits = pieces.groupBy("file", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    splits = _staged(splits.withColumn("rank", F.row_number().over(Window.orderBy("file", "block"))), "splits")  # a row for each split
    if splits.isEmpty():
        return spark.createDataFrame([], _PARTS)
    whole_row = F.col("row") & F.col("cut") & F.col("behind")
    pieces = pieces.withColumn("mark", F.lit(False))
    others, rows = _staged(_summed(pieces.filter(~whole_row)), "others"), pieces.filter(whole_row)
    stretches = _staged(_stretches(others, splits), "stretches")
    filled = F.col("hi") > F.col("lo") + 1
    alone = stretches.filter(filled & ~F.col("in_string") & (F.col("braces") == 1) & (F.col("brackets") == 1))
    if not stretches.filter(F.col("in_string") & filled).isEmpty():
        # what looks like rows lies in a string: every piece is summed, and none is taken as it is
        alone, others, rows = alone.limit(0), _summed(pieces), rows.limit(0)
    # rows that do not lie straight in an array; begun outside of strings, each ends as deep as it begins
    deeper = rows.join(_in_chunks(alone), _inside(), "left_anti").withColumns({n: F.lit(int(n == "b0")) for n in _SUMS})
    rest = others.unionByName(deeper).unionByName(_marks(splits))
    rows = _staged(_begun(_ranked(rest, splits)), "begun")
    # what follows the document is left out
    ends = rows.filter((F.col("braces_after") <= 0) & F.col("cut")).agg(F.min(F.struct("file", "block", "at")).alias("end"))
    end = ends.first().end  # one row
    if end is None:
        raise ValueError(f"the document at {path} does not end")
    last = F.struct(F.struct(F.lit(end.file.length).alias("length"), F.lit(end.file.path).alias("path")).alias("file"), F.lit(end.block).cast("long").alias("block"), F.lit(end.at).cast("long").alias("at"))
    rows = rows.filter(F.struct("file", "block", "at") <= last)
    # a part begins behind an object of the document's arrays or fields
    first = ~F.col("quoted") & (F.col("braces") == 1) & (F.col("brackets") <= 1) & F.col("behind")
    same = (F.col("brackets") == 1) & F.col("value").rlike(r"\A\s*,\s*(\{|\z)")
    rows = rows.withColumn("first", first).withColumn("opening", ((F.col("first") & ~same) | (F.col("braces") == 0)) & ~F.col("mark"))
    rows = _running(rows, ["first", "opening"])
    text = F.concat("value", F.when(F.col("cut"), F.lit(_CUT)).otherwise(F.lit("")))
    place = F.shiftleft(F.col("rank").cast("long"), _PLACE) + F.col("at") % (1 << _PLACE)
    grouped = rows.groupBy("n_first").agg(
        F.min(F.when(~F.col("mark"), place)).alias("part"), F.max("n_opening").alias("field"), F.max("opening").alias("opens"),
        F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("file", "block", "at", text.alias("text")))), lambda x: x["text"]), "").alias("text"),
        F.max_by(F.struct("braces_after", "brackets_after"), F.struct("file", "block", "at")).alias("end"),
    )
    # the parts that open a field, those that go on and the fields' names are read from it: the pieces are put together once
    grouped = _staged(grouped, "grouped")
    rest = F.regexp_replace("text", r"\A[\s\x{FEFF}]*(?:\{|\]?\s*,?)", "")
    close = F.when(F.col("end.braces_after") <= 0, F.lit("")).when(F.col("end.brackets_after") > 0, F.lit("]}")).otherwise(F.lit("}"))
    opened = grouped.filter("opens").select("part", "field", _checked(F.concat(F.lit("{"), rest, close)).alias("json"))
    going = grouped.filter("NOT opens").select("part", "field", F.concat(F.regexp_replace("text", r"\A\s*,", ""), close).alias("json"))
    # a field's name is that of the last one of the part that opens it
    names = opened.select(F.col("field").alias("__field"), F.try_element_at(F.json_object_keys("json"), F.lit(-1)).alias("name"))
    named = going.join(names, F.col("field") == F.col("__field"))
    continued = named.select("part", F.lit(False).alias("opens"), "name", _under(F.col("name"), F.col("json")).alias("json"))
    fields = rows.select(F.col("file").alias("__file"), F.col("block").alias("__block"), "at", "n_opening")
    taken = alone.join(fields, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")) & (F.col("lo") == F.col("at"))).join(names, F.col("n_opening") == F.col("__field"))
    taken = _staged(_in_chunks(taken, "rank", "name"), "taken")
    row = F.concat(F.expr("substring(value, instr(value, ',') + 1)"), F.lit("}]}"))  # behind the comma before it
    as_they_are = texts.select("at", "value").join(taken, _inside()).select(place.alias("part"), F.lit(False).alias("opens"), "name", _under(F.col("name"), row).alias("json"))
    return opened.select("part", F.lit(True).alias("opens"), F.lit(None).cast("string").alias("name"), "json").unionByName(continued).unionByName(as_they_are)
