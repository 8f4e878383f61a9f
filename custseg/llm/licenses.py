"""License scan by diagonal voting, in DataFrame functions only.

A text's lower-cased words become rolling k-gram hashes (k = 2) with their positions. A join with
the template positions that have the same hash gives matches (document position, template
position); all matches of one copy of a template lie on one diagonal (document position minus
template position). Matches vote per document, template and diagonal. Each vote is verified: the
words of the document's k-gram must equal the template's, so hash collisions fall out before they
count. A diagonal holds the set of template positions that voted on it, as bits, so a position
counts once, whatever the text repeats.

Neighbouring diagonals of a long template merge into a span: those from a diagonal up to one position
per ``WORDS_PER_SHIFT`` template words further, which lets a copy have inserted or missing words
and keeps a span as wide as the template and that shift. Merged spans are verified: the words must
stand in the template's order, so what counts is a chain of k-grams in which both the template
position and the document position rise. The share of the template's k-grams in that chain is the
span's cover. A long template needs ``MIN_COVER``; base phrases and short templates need all of
it on one diagonal.

The template table is a constant of this module (a few hundred k-grams), so broadcasting it is
bounded. The k-grams are exploded and probed inside the task that reads the text; only matches
(and one row per document) are shuffled, keyed by document, so a license line that a third of all
documents carry is no hot key.

Defined results: a null or empty text has no words. Documents are told apart by (doc_id, text
hash, length): rows equal in all of these are equal rows, are scanned once and come out as often
as they come in. Very long texts are scanned whole; an empty table gives no rows. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Passages of well-known public licenses (label, text) for the method's own labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
K = 2
MIN_COVER = 0.8
LONG_TEMPLATE = 12      # k-grams from which a template may match in part
WORDS_PER_SHIFT = 8

_ROW_MARK = "\x00"         # no word holds this character
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words() -> Column:
    """The text's words: it is cut at runs of other characters, empty ends are dropped."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(text, _BREAK), "")


def _literal_rows(spark, rows, names) -> DataFrame:
    """A small constant table made of literals."""
    items = [F.struct(*(F.lit(x).alias(n) for x, n in zip(row, names))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def _template_grams(spark, templates) -> DataFrame:
    """One row per template position: hash, the gram's words, the template's facts."""
    rows = [(-1, 0, 1, _ROW_MARK, "", False)]
    for t, (label, text, is_base) in enumerate(templates):
        words = _WORD.findall(text)
        if not K <= len(words) < K + 63:
            raise ValueError(f"a template needs {K} to {K + 62} words: {text!r}")
        rows += [(t, i, len(words) - K + 1, " ".join(words[i:i + K]), label, is_base)
                 for i in range(len(words) - K + 1)]
    return (_literal_rows(spark, rows, ("template", "t_pos", "t_grams", "t_words", "label",
                                        "is_base"))
            .withColumn("gram", F.xxhash64("t_words")))


def _chain(masks: list[Column], grams: Column) -> Column:
    """The most k-grams on diagonals 0, 1, ... that stand in order: both positions rise.

    ``masks``: the template positions of each diagonal, as bits. The k-grams are taken in the
    template's order; each ends the longest chain of earlier ones that it can follow.
    """
    def on(i: int, mask: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), grams - 1), lambda t: F.getbit(mask, t) == 1)
        return F.transform(places, lambda t: F.struct(t.alias("t"), (t + i).alias("p")))

    pairs = F.array_sort(F.flatten(F.array(*[on(i, mask) for i, mask in enumerate(masks)])))

    def step(ends: Column, x: Column) -> Column:
        before = F.filter(ends, lambda e: (e["t"] < x["t"]) & (e["p"] < x["p"]))
        longest = F.coalesce(F.array_max(F.transform(before, lambda e: e["n"])), F.lit(0))
        return F.concat(ends, F.array(F.struct(x["t"].alias("t"), x["p"].alias("p"),
                                               (longest + 1).alias("n"))))

    ends = F.aggregate(pairs, F.array().cast("array<struct<t:int,p:int,n:int>>"), step)
    return F.array_max(F.transform(ends, lambda e: e["n"]))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the largest share of a template's k-grams in a span)."""
    every = ([(label, text, True) for text, label in base]
             + [(label, text, False) for label, text in templates])
    grams = F.broadcast(_template_grams(docs.sparkSession, every))     # a constant: bounded
    key = ["doc_id", "h", "n_chars"]
    words = docs.select("doc_id", F.xxhash64("text").alias("h"),
                        F.length("text").alias("n_chars"), _words().alias("words"))
    # word i with word i + 1 (the last word gives null), then a mark: every row matches there,
    # at the position that is its number of words
    following = F.slice("words", F.lit(2), F.size("words"))
    rolling = F.concat(F.zip_with("words", following, lambda a, b: F.concat(a, F.lit(" "), b)),
                       F.array(F.lit(_ROW_MARK)))
    votes = (words.select(*key, rolling.alias("grams"))
             .select(*key, F.posexplode("grams").alias("pos", "words"))
             .withColumn("gram", F.xxhash64("words"))
             .join(grams, "gram")
             .filter(F.col("words") == F.col("t_words"))
             .groupBy(*key, "template", "label", "is_base", "t_grams",
                      (F.col("pos") - F.col("t_pos")).alias("diagonal"))
             .agg(F.expr("bit_or(shiftleft(1L, t_pos))").alias("mask"),
                  F.count(F.lit(1)).alias("votes")))
    # the diagonals that follow one: of the same document and template, and few
    longest = max((len(_WORD.findall(text)) for _, text, _ in every), default=0)
    most = longest // WORDS_PER_SHIFT
    along = (Window.partitionBy(*key, "template").orderBy("diagonal")
             .rowsBetween(Window.currentRow, most))
    shift = F.when(F.col("is_base") | (F.col("t_grams") < LONG_TEMPLATE), 0).otherwise(
        F.floor((F.col("t_grams") + K - 1) / WORDS_PER_SHIFT))
    near = F.map_from_entries(F.collect_list(F.struct("diagonal", "mask")).over(along))
    masks = [F.col("mask")] + [
        F.when(F.lit(i) <= F.col("shift"), F.coalesce(F.col("near")[F.col("diagonal") + i],
                                                      F.lit(0))).otherwise(0)
        for i in range(1, most + 1)]
    alone = F.greatest(*masks[1:], F.lit(0)) == 0
    spans = (votes.withColumn("near", near).withColumn("shift", shift)
             .withColumn("grams", F.when(alone, F.bit_count("mask"))
                         .otherwise(_chain(masks, F.col("t_grams"))))
             .withColumn("rows", F.when(F.col("template") < 0, F.col("votes"))))
    rows = F.max("rows").over(Window.partitionBy(*key))     # equal input rows vote together
    cover = F.col("grams") / F.col("t_grams")
    exact = F.col("is_base") | (F.col("t_grams") < LONG_TEMPLATE)
    found = (F.col("template") >= 0) & (F.col("cover") >= F.when(exact, 1.0).otherwise(MIN_COVER))
    base_found = F.col("is_base") & F.col("found")

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    per_row = (spans.withColumn("n_rows", rows).withColumn("cover", cover)
               .withColumn("found", found)
               .groupBy(*key)
               .agg(F.max(F.when(F.col("template") < 0, F.col("diagonal"))).cast("long")
                    .alias("n_words"),
                    F.count(F.when(base_found, 1)).alias("n_base"),
                    F.min(F.when(base_found, F.col("diagonal"))).cast("long")
                    .alias("first_word"),
                    F.max(F.when(base_found, F.col("diagonal"))).cast("long")
                    .alias("last_word"),
                    labels(base_found).alias("base_labels"),
                    labels(F.col("found")).alias("labels"),
                    F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("cover"))),
                               F.lit(0.0)).alias("score"),
                    F.max("n_rows").cast("int").alias("n_rows")))
    return (per_row.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("n_rows"))))
            .drop("h", "n_chars", "n_rows", "_copy"))
