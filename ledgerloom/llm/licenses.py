"""License scans by diagonal voting.

Every rolling hash of k words of every text is joined to the positions at which the
templates have it. A match of word i of a text with word j of a template votes for the
diagonal i - j. Votes are gathered by diagonal; neighbouring diagonals, which a word put
in or left out sets apart, are merged; and a merged span is verified: by the words
themselves, not their hashes, by the share of the template that it covers, and by its
length. A phrase must stand whole on one diagonal.

Everything is DataFrame functions. Texts are read once and never shuffled: words are
exploded where they are read, and what is shuffled is a row for each text and for each vote,
dealt by text. The templates are broadcast; their words are bounded by `MOST_WORDS`.

Cases: null text counts as empty; an empty text has no words and a row of zeros; a null id is
kept; repeated rows are reported each (rows are told apart by where they are read); an empty
table gives no rows; other columns are ignored. Places overlap freely, and each counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_of

#: What separates words, once A to Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The templates are broadcast: more words than these are an error.
MOST_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    """A label's text. A phrase must stand whole; of another text a share must be covered."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(re.findall("[0-9a-z\x80-\U0010ffff]+", self.text.translate({ord(c): c.lower() for c in UPPER})))


#: Phrases and the labels they stand for; fixed values.
PHRASES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)
#: Notices of public licenses; fixed values.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES = PHRASES + NOTICES


@dataclass(frozen=True)
class Rule:
    """k: words of a hash; slack: by how much neighbouring diagonals differ; share: of a template's words."""

    k: int = 2
    slack: int = 3
    share: float = 0.8


def words_of(text: Column) -> Column:
    """The words of a text, A to Z in lower case."""
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS), "")


def _gram(words: str, at: str, k: int) -> Column:
    """The hash of k words from a position; null where the text ends before."""
    own = [F.expr(f"get({words}, {at} + {i})") for i in range(k)]
    return F.when(own[-1].isNotNull(), F.xxhash64(*own))


def template_positions(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """A row for each hash of each template: key, template, tpos, tgram (its words), and the template's label, length and kind."""
    if short := [t.label for t in templates if len(t.words) < k]:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    if sum(len(t.words) for t in templates) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words in all")
    rows = [F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.array(*map(F.lit, t.words)).alias("twords")) for i, t in enumerate(templates)]
    each = spark.range(1).select(F.inline(F.array(*rows))).select("*", F.posexplode("twords").alias("tpos", "first"))
    return each.select(_gram("twords", "tpos", k).alias("key"), "template", "tpos", F.slice("twords", F.col("tpos") + 1, k).alias("tgram"), "label", "phrase", F.size("twords").alias("length")).filter("key IS NOT NULL")


def _votes(df: DataFrame, templates: tuple[Template, ...], rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """A row for each verified vote (template not null), and one for each text; dealt by text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), words_of(text_of(text_col)).alias("words"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words")
    # one position more than there are words: the row of the text itself
    places = rows.select("row", "doc_id", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    places = places.select("row", "doc_id", "words", "pos", _gram("words", "pos", rule.k).alias("gram"))
    known = F.broadcast(template_positions(df.sparkSession, templates, rule.k))
    same = (F.col("gram") == F.col("key")) & (F.expr(f"slice(words, pos + 1, {rule.k})") == F.col("tgram"))
    met = places.join(known, same, "left").filter("template IS NOT NULL OR pos = size(words)")
    out = met.select("row", "doc_id", "pos", F.size("words").alias("n_words"), "template", "tpos", "label", "phrase", "length", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    return out.repartition("row")


_OWN = ["row", "doc_id", "template", "label", "phrase", "length"]


def _spans(votes: DataFrame, rule: Rule) -> DataFrame:
    """The verified spans and, without a template, the texts themselves: (row, doc_id, template, n_words, label, phrase, first, last, covered, share).

    One pass over the votes; first and last are words of the text.
    """
    lines = votes.groupBy(*_OWN, "diagonal").agg(F.collect_set("tpos").alias("places"), F.max("n_words").alias("n_words"))  # a template's words at most
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(along) > rule.slack)
    lines = lines.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(along))
    # of neighbouring diagonals: which of the template's words they cover, and from where to where in the text
    ends = [F.min(F.col("diagonal") + F.array_min("places")).alias("first"), F.max(F.col("diagonal") + F.array_max("places") + (rule.k - 1)).alias("last")]
    merged = lines.groupBy(*_OWN, "group").agg(F.flatten(F.collect_list("places")).alias("places"), F.max("n_words").alias("n_words"), *ends)
    covered = F.expr(f"size(array_distinct(flatten(transform(places, p -> sequence(p, p + {rule.k - 1})))))")
    spans = merged.withColumn("covered", covered).withColumn("share", F.col("covered") / F.col("length"))
    whole = F.when(F.col("phrase"), F.col("covered") == F.col("length")).otherwise((F.col("share") >= rule.share) & (F.col("last") - F.col("first") < 2 * F.col("length")))
    return spans.filter(F.col("template").isNull() | whole).select("row", "doc_id", "template", "n_words", "label", "phrase", "first", "last", "covered", "share")


def license_spans(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where texts carry license notices: doc_id, label, phrase, first and last word, covered words, share of the template."""
    rule = rule or Rule()
    return _spans(_votes(df, templates, rule, id_col, text_col), rule).filter("template IS NOT NULL").drop("row", "template", "n_words")


def license_digests(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its words, its phrases' places, its labels and a score.

    The score is the largest over its spans of covered words to one more than the template has, 0 without a span.
    """
    rule = rule or Rule()
    spans = _spans(_votes(df, templates, rule, id_col, text_col), rule)
    base = F.when(F.col("phrase"), F.col("first")).cast("long")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.col("covered") / (F.col("covered") / F.col("share") + 1)), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def oracle(templates: tuple[Template, ...] = TEMPLATES, rule: Rule | None = None) -> str:
    """The same over `documents` as DuckDB SQL, words in place of their hashes."""
    rule = rule or Rule()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {quote(t.label)}, {str(t.phrase).lower()}, [{', '.join(map(quote, t.words))}])" for i, t in enumerate(templates))
    return rf"""
        WITH t(template, label, phrase, twords) AS (VALUES {listed}),
        tg AS (
            SELECT template, label, phrase, len(twords) AS length, j - 1 AS tpos, twords[j:j + {rule.k - 1}] AS gram
            FROM (SELECT *, unnest(range(1, len(twords) + 2 - {rule.k})) AS j FROM t)
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), p AS (
            SELECT r, pos, [{', '.join(f'w{i}' for i in range(rule.k))}] AS gram
            FROM (SELECT r, unnest(range(len(words) + 1 - {rule.k})) AS pos, {', '.join(f'unnest(words[{i + 1}:len(words) + 1 + {i} - {rule.k}]) AS w{i}' for i in range(rule.k))} FROM d)
        ), v AS (
            SELECT DISTINCT r, template, label, phrase, length, tpos, pos - tpos AS diagonal FROM p JOIN tg USING (gram)
        ), n AS (
            SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER w > {rule.slack} OR lag(diagonal) OVER w IS NULL THEN diagonal END AS begins
            FROM (SELECT DISTINCT r, template, phrase, diagonal FROM v) WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)
        ), g AS (
            SELECT r, template, diagonal, max(begins) OVER (PARTITION BY r, template ORDER BY diagonal) AS grp FROM n
        ), c AS (
            SELECT r, template, label, phrase, length, grp, min(diagonal + tpos) AS first, max(diagonal + tpos + {rule.k - 1}) AS last,
                   len(list_distinct(flatten(list(range(tpos, tpos + {rule.k}))))) AS covered
            FROM v JOIN g USING (r, template, diagonal) GROUP BY ALL
        ), s AS (
            SELECT * FROM c
            WHERE CASE WHEN phrase THEN covered = length ELSE covered / length >= {rule.share} AND last - first < 2 * length END
        )
        SELECT any_value(doc_id) AS doc_id, any_value(len(words)) AS n_words,
               count(*) FILTER (phrase) AS n_base, CAST(min(first) FILTER (phrase) AS BIGINT) AS first_word, CAST(max(first) FILTER (phrase) AS BIGINT) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
               coalesce(max(covered / (length + 1)), CAST(0 AS DOUBLE)) AS score
        FROM d LEFT JOIN s USING (r) GROUP BY r
    """
