"""Small document tables with every awkward case."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, rows, **extra):
    """documents of (id, text) pairs; extra: more columns, by name, with one value."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df


AWKWARD = [
    (1, "a b c"),
    (2, "abc"),
    (3, None),
    (4, ""),
    (5, "  \t\n"),
    (6, "x" * 50_000 + " y"),
    (7, "x" * 50_000 + "y"),
    (8, "ünï 😀 cödé"),
    (8, "ünï 😀 cödé"),
    (None, "abc"),
    (10, "only one"),
    (11, "a b c"),
]
