"""Spelling variants: words one edit apart, grouped under the frequent form.

Words are near if one code point put in, left out or changed turns one into the other. Such
an edit leaves one half of a word intact, so near words stand in one block of the forward
dictionary (they share a prefix of half their length) or of the reversed one (they share a
suffix). A block is a range of the sorted dictionary. One of more words than `most` is
subdivided: of what its words don't share, again one half is intact, so each word moves on
to a block of a longer prefix and to one of a longer suffix, and so on, until the blocks are
small or only one code point is left open, which few words can differ in. Within a block
words are compared in full. A pair that several blocks hold is taken in one of them.

Blocks join words of one length, the class, with each other and with those one longer. Block
sizes are counted before words meet; a block with one word, or without a word of its class, ends.

Cases: null text counts as empty; a null id stands as an empty text before the colon;
repeated rows count again; a very long run is a word like any other; an empty table has no
words; other columns are ignored. Of forms of equal count the smallest in code-point order
is taken; a form must have `ratio` times the word's count, so that following forms ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of, written

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Which words count, how often, and how many words a block has before it is subdivided."""

    length: int = 6
    least: int = 5
    ratio: int = 5
    every: int = 199
    most: int = 64


def counted_words(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough, some damaged by the rule of `every`."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text_col), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= rule.length).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    hashed = runs.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % rule.every == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= rule.length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rule.least)


def _halves(words: DataFrame) -> DataFrame:
    """Each word moved on to the block of a longer prefix and to that of a longer suffix.

    words: word, n, size (the class's length), pre and post, the lengths of the shared prefix and suffix.
    """
    open_ = F.col("size") - F.col("pre") - F.col("post")
    first = F.floor(open_ / 2).cast("int")
    forward = F.struct((F.col("pre") + first).alias("pre"), F.col("post").alias("post"))
    reverse = F.struct(F.col("pre").alias("pre"), (F.col("post") + open_ - first).alias("post"))
    moved = words.select("word", "n", "size", F.explode(F.array(forward, reverse)).alias("to")).select("word", "n", "size", "to.pre", "to.post")
    own = F.xxhash64(F.substring("word", F.lit(1), F.col("pre")), F.expr("right(word, post)"), F.col("size"), F.col("pre"), F.col("post"))
    return moved.withColumn("block", own)


def _compared(blocks: DataFrame) -> DataFrame:
    """The near pairs of small blocks: (word, n, near, near_n), each pair once.

    Both sides are sorted by block and the equal ranges scanned.
    """
    short = blocks.filter(F.length("word") == F.col("size"))
    other = blocks.select(F.col("block").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    longer = F.length("near") > F.col("size")
    pairs = short.join(other.hint("merge"), (F.col("block") == F.col("b")) & (longer | (F.col("near") > F.col("word"))))
    # a pair that shares more than half is taken where its prefix goes on
    once = (F.col("post") == 0) | (F.substring("word", F.lit(1), F.col("size") - F.col("post")) != F.substring("near", F.lit(1), F.col("size") - F.col("post")))
    near = F.levenshtein("word", "near", 1) == 1
    return pairs.filter(once & near).select("word", "n", "near", "near_n")


def near_pairs(words: DataFrame, rule: Rule) -> list[DataFrame]:
    """Tables of near pairs (word, n, near, near_n), together each pair once. words: a written table of (word, n)."""
    spread = F.explode(F.expr(f"filter(array(length(word), length(word) - 1), c -> c >= {rule.length})")).alias("size")
    state = _halves(words.select("word", "n", spread, F.lit(0).alias("pre"), F.lit(0).alias("post")))
    found = []
    while True:
        state = written(state, "blocks")
        own = F.length("word") == F.col("size")
        sizes = state.groupBy("block").agg(F.count(F.lit(1)).alias("in_block"), F.count_if(own).alias("of_class"))
        # one word, or none of the class, is near to nothing here
        sizes = sizes.filter("in_block > 1 AND of_class > 0").select(F.col("block").alias("b"), "in_block")
        joined = state.join(sizes, F.col("block") == F.col("b")).drop("b")
        small = (F.col("in_block") <= rule.most) | (F.col("size") - F.col("pre") - F.col("post") <= 1)
        kept = written(joined.withColumn("small", small), "sized")
        found.append(written(_compared(kept.filter("small")), "pairs"))
        large = kept.filter("NOT small")
        if large.isEmpty():
            return found
        state = _halves(large)


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root): where following the forms ends. forms: a written table of (word, form)."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        step = now.join(ahead, F.col("root") == F.col("w"), "left")
        after = written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The words with their form, root, near words' count and the form's count. words: (word, n), each word once."""
    rule = rule or Rule()
    words = written(words, "words")
    pairs = None
    for p in near_pairs(words, rule):
        pairs = p if pairs is None else pairs.unionByName(p)
    both = pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best).select(F.col("word").alias("w"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    taken: Column = F.col("near_n") >= rule.ratio * F.col("n")
    rows = words.join(near, F.col("word") == F.col("w"), "left")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n"))
    rows = written(rows, "forms")
    roots = _followed(rows.filter("form IS NOT NULL")).select(F.col("word").alias("w"), "root")
    return rows.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per frequent word of all texts: word, form, root, n, n_near, form_n."""
    rule = rule or Rule()
    return variants(counted_words(df, rule, id_col, text_col), rule)
