"""Reading and writing datasets: one JSON document, or the typed tables that it becomes."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import pieces
from ledgerloom.sources.shared import shared_path

REQUIRED = ("transactions", "sources", "monthly", "quarter", "defaultPeriod", "recurring")

#: Document fields and the ledger's names for them; fixed values.
_FIELDS = {
    "id": ("id", "string"), "date": ("date", "date"), "merchant": ("merchant", "string"), "amount_cents": ("amountCents", "bigint"), "category": ("category", "string"),
    "source_category": ("sourceCategory", "string"), "kind": ("kind", "string"), "source": ("source", "string"), "confidence": ("confidence", "string"), "flags": ("flags", "array<string>"),
    "note": ("note", "string"), "direction": ("direction", "string"), "income_type": ("incomeType", "string"), "classification_changed": ("classificationChanged", "boolean"),
    "needs_review": ("needsReview", "boolean"), "needs_category_review": ("needsCategoryReview", "boolean"), "needs_item_review": ("needsItemReview", "boolean"),
    "needs_scope_review": ("needsScopeReview", "boolean"), "source_row": ("sourceRow", "int"),
}
#: The ledger's columns that a document gives.
COLUMNS = [*_FIELDS, "evidence_summary", "month_idx"]


SAMPLE = "sample-data.json"


def choose(folder: str, sample: bool = False) -> str:
    """The dataset to read: the folder's own document (<name>-data.json) where there is one, unless the sample is asked for."""
    own = sorted(x for x in glob.glob(os.path.join(folder, "*-data.json")) if os.path.basename(x) != SAMPLE)
    return own[0] if own and not sample else os.path.join(folder, SAMPLE)


def _required(parts: DataFrame) -> DataFrame:
    """A document's parts with all their required fields."""
    names = parts.filter("opens").select(F.explode(F.json_object_keys("json")).alias("k")).distinct()
    have = {r.k for r in names.filter(F.col("k").isin(*REQUIRED)).collect()}  # at most the required ones
    if lacking := [x for x in REQUIRED if x not in have]:
        raise ValueError(f"the dataset lacks {', '.join(lacking)}")
    return parts


def check_required(spark: SparkSession, path: str) -> None:
    """Raise unless the document has all required fields."""
    _required(pieces.parts(spark, path))


def read_json(spark: SparkSession, path: str, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """A document's ledger, all of it or the asked columns, sources and monthly coverage, read by as many tasks as its file, or the fragments of a folder, have splits."""
    return _tables(_required(pieces.parts(spark, path)), columns or COLUMNS)


def _schema(columns: list[str]) -> str:
    """A document's, of whose rows only what the columns need is parsed."""
    needed = {*columns} | ({"date"} if "month_idx" in columns else set())
    row = [f"{name}:{'string' if kind == 'date' else kind}" for own, (name, kind) in _FIELDS.items() if own in needed]
    row += ["classificationEvidence:struct<summary:string,basis:string,confidence:string>"] * ("evidence_summary" in needed)
    return f"transactions array<struct<{','.join(row)}>>, sources array<struct<id:string,label:string>>, monthly array<struct<month:string,hasMainCardCoverage:boolean,transactionCount:bigint,spendingCents:bigint>>"


def _tables(parts: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    schema = _schema(columns)

    def of(name: str) -> DataFrame:
        """The rows of a field: parts of other fields alone are not parsed."""
        own = parts.filter(F.col("opens") | (F.col("name") == name))
        return own.select(F.from_json("json", schema).alias("d")).select(F.inline(f"d.{name}"))

    rows = of("transactions")
    date = F.col("date").cast("date")
    made = {own: F.col(name).cast(kind) for own, (name, kind) in _FIELDS.items()} | {"evidence_summary": F.col("classificationEvidence.summary"), "month_idx": F.year(date) * 12 + F.month(date) - 1}
    ledger = rows.select(*[made[c].alias(c) for c in columns])
    index = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int") - 1).alias("month_idx")
    monthly = of("monthly").select(index, F.col("hasMainCardCoverage").alias("covered"), F.col("transactionCount").alias("transaction_count"), F.col("spendingCents").alias("spending_cents"))
    return {"ledger": ledger, "sources": of("sources"), "monthly": monthly}


def read_embedded(spark: SparkSession, path: str, element: str) -> DataFrame:
    """The JSON text of an inert script element of a page, one row for each file: (json)."""
    page = spark.read.text(path, wholetext=True)
    found = F.regexp_extract("value", f"(?s)<script[^>]*\\bid=[\"']{element}[\"'][^>]*>(.*?)</script>", 1)
    return page.select(F.trim(found).alias("json")).filter("json <> ''")


def embedded_tables(spark: SparkSession, path: str, element: str) -> dict[str, DataFrame]:
    """The tables of a document that a page carries, read like the document's own file."""
    return _tables(_required(pieces.parts(spark, path, element)), COLUMNS)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name; the ledger is clustered by month."""
    for name, df in tables.items():
        out = df.repartition("month_idx").sortWithinPartitions("month_idx") if name == "ledger" else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: tuple[str, ...] = ("ledger", "sources", "monthly")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def _safe(df: DataFrame) -> Column:
    return F.replace(F.to_json(F.struct(*df.columns)), F.lit("<"), F.lit("\\u003c"))


def safe_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text that may stand in a script tag: every < is escaped."""
    return df.select(_safe(df).alias("json"))


def write_document(tables: dict[str, DataFrame], path: str, compression: str = "none") -> None:
    """A JSON document with an array for each table, every < escaped, as ordered fragments.

    The part files at the path, in the order of their numbers, are the document, each packed by itself if asked for; `read_json` reads
    them as they are, and `join_document` puts them together. Rows are turned to text and written where they are; none is sorted, staged or gathered.
    """
    spark = next(iter(tables.values())).sparkSession

    def line(text: str) -> DataFrame:
        return spark.range(0, 1, 1, 1).select(F.lit(text).alias("text"))

    whole = None
    for i, (name, df) in enumerate(tables.items()):
        start = line(("{" if i == 0 else "],") + f'"{name}":[')
        # what stands between the rows goes before each one but the first of the first partition
        comma = F.when(F.monotonically_increasing_id() == 0, F.lit("")).otherwise(F.lit(","))
        rows = start.union(df.select(F.concat(comma, _safe(df)).alias("text")))  # partitions in this order
        whole = rows if whole is None else whole.union(rows)
    whole.union(line("]}")).write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", _FRAGMENT).text(path)
    _begin_arrays(spark, path)


#: Rows of a fragment at most: a packed one is read by one task. Names keep their order up to a thousand fragments of a partition.
_FRAGMENT = 1_000_000


def _fragments(spark: SparkSession, path: str):
    """(file system, fragments in their order, opener): the opener reads one, unpacked."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs, codecs = folder.getFileSystem(conf), jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    parts = sorted((x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), key=lambda p: (len(p.getName()), p.getName()))

    def opened(p):
        codec = codecs.getCodec(p)
        return codec.createInputStream(fs.open(p)) if codec else fs.open(p)

    return fs, parts, opened


def _begin_arrays(spark: SparkSession, path: str) -> None:
    """Takes the comma off an array's first fragment where the first partition of its table was empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, parts, opened = _fragments(spark, path)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    begun = opening = False
    for p in parts:
        source = opened(p)
        try:
            first = source.read()
            begins = chr(first) if first >= 0 else ""
            if opening and begins == ",":
                own, codec = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}"), codecs.getCodec(p)
                out = codec.createOutputStream(fs.create(own, True)) if codec else fs.create(own, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, True)
                fs.delete(p, False)
                fs.rename(own, p)
        finally:
            source.close()
        if begins:
            opening = begins == "]" or not begun
            begun = True


def join_document(spark: SparkSession, path: str, target: str) -> None:
    """The fragments at a path as one file: copied in turn, a buffer at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(target)
    _, parts, opened = _fragments(spark, path)
    out = file.getFileSystem(conf).create(file, True)
    try:
        for p in parts:
            source = opened(p)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
