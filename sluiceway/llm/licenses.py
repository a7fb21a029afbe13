"""License scans as an exact set-similarity join, with DataFrame expressions only.

A template is a set of words and a block is every run of as many consecutive words of a text as the
template has. A block meets the template if it contains at least ``share`` of its distinct words.
Words are ordered by their frequency in the whole corpus, rarest first. Then

* length: a text with fewer words than that share has no such block,
* prefix: a block that meets a template of d words in ``need`` of them contains one of its first
  d - need + 1 words, the rarest ones, so other texts are left out before anything moves,
* position: all blocks lie within a block's length of the first and last of these rare words, and
  the words found there must still reach ``need``.

What is left is counted exactly: a word contributes to all block starts from which it is the first of
its kind, an interval, and the running sum over the ends of these intervals is the number of
template words in every block of the text. Phrases are templates with all words, whose words are then
aligned.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import quoted, text_of
from sluiceway.sources import lineage_cut

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Short notices by which works are put under public licenses, and their labels.
NOTICES = {
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files": "mit-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the "
    "license at": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license": "gpl-notice",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
SHARE = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    need: int  # distinct words a block must have
    phrase: bool


def templates(phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
              share: float = SHARE) -> list[Template]:
    """Phrases need all of their words, notices ``share`` of them. Wordless ones are left out."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    out = []
    for phrase, table in ((True, PHRASES if phrases is None else phrases),
                          (False, NOTICES if notices is None else notices)):
        for text, label in table.items():
            words = tuple(x for x in re.split(_APART, text.translate(str.maketrans(_UPPER, _LOWER))) if x)
            if words:
                distinct = len(set(words))
                need = distinct if phrase else max(1, math.ceil(share * distinct - 1e-9))
                out.append(Template(len(out), label, words, need, phrase))
    return out


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; an empty array for a text without any."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _APART), "")


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How often the words of the templates occur in all texts; one number a word to the driver."""
    found = docs.select(F.explode_outer(words_of(text_of(text_col))).alias("word"))
    counted = found.filter(F.col("word").isin(vocabulary)).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         share: float = SHARE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per document.

    ``n_base`` counts the places of all phrases; places overlap freely. First and last are the
    smallest and largest word number where one starts, null without any. Labels are sorted and joined
    by commas, empty without any. ``score`` is the largest share of a template that a block contains,
    among the templates met: 1 with a phrase, 0 without label. Null texts are empty. Every repeated
    row has a row of its own, also without id. Texts of any length are scanned whole: what is kept of
    one is its template words, and only if it has a rare one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    all_ = templates(phrases, notices, share)
    often = frequencies(docs, sorted({w for t in all_ for w in t.words}), text_col)
    kept = lineage_cut(_probed(docs, all_, often, id_col, text_col))
    hits = kept.select("row", "templates", F.explode("hits").alias("hit")).select(
        "row", "templates", "hit.at", "hit.word")
    base = _phrase_places(hits, _tokens(spark, [t for t in all_ if t.phrase], often))
    met = _blocks_met(hits, _tokens(spark, [t for t in all_ if not t.phrase], often))
    none = F.array().cast("array<string>")
    rows = kept.select("row", "id", "n_words").join(base, "row", "left").join(met, "row", "left")
    labels = F.array_union(F.coalesce("base_set", none), F.coalesce("more_set", none))
    return rows.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def prefix(t: Template, often: dict[str, int]) -> list[str]:
    """The rarest distinct words of a template of which every block that meets it has one."""
    order = sorted(set(t.words), key=lambda w: (often.get(w, 0), w))
    return order[: len(order) - t.need + 1]


def _probed(docs: DataFrame, all_: list[Template], often: dict[str, int], id_col: str,
            text_col: str) -> DataFrame:
    """Per row: a number, id, words, the templates that pass the length and the prefix filter and, if
    there are any, all places of template words."""
    rare = {t.number: prefix(t, often) for t in all_}
    read = docs.select(quoted(id_col).alias("id"), words_of(text_of(text_col)).alias("w"))

    def any_of(words: list[str]) -> Column:
        return F.arrays_overlap("w", F.array(*map(F.lit, sorted(words))).cast("array<string>"))

    passed = [F.when((F.size("w") >= t.need) & any_of(rare[t.number]), F.lit(t.number)) for t in all_]
    probed = read.select(
        "id", "w",
        F.when(any_of({w for words in rare.values() for w in words}),
               F.array_compact(F.array(*passed).cast("array<int>"))).alias("templates"),
    )
    vocabulary = sorted({w for t in all_ for w in t.words})
    places = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
                      lambda x: x["word"].isin(vocabulary))
    return probed.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.size("w").cast("long").alias("n_words"), "templates",
        F.when(F.size("templates") > 0, places).alias("hits"),
    )


def _tokens(spark: SparkSession, some: list[Template], often: dict[str, int]) -> DataFrame:
    """One row per template and word place, as the index that the places of texts are joined with."""
    rows = [
        (t.number, t.label, word, at, word in prefix(t, often), at == t.words.index(word),
         len(t.words), len(set(t.words)), t.need)
        for t in some for at, word in enumerate(t.words)
    ]
    return F.broadcast(spark.createDataFrame(  # bounded by the templates, which are configuration
        rows, "template int, label string, word string, offset int, rare boolean, once boolean, "
        "length int, distinct_words int, need int"))


def _phrase_places(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per row with a phrase: places, first and last start, labels. All words must stand in line."""
    start = (F.col("at") - F.col("offset")).alias("start")
    return (
        hits.join(tokens, "word").filter(F.array_contains("templates", F.col("template")))
        .groupBy("row", "template", "label", "length", start).agg(F.count("*").alias("n"))
        .filter("n = length")
        .groupBy("row").agg(
            F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"),
            F.max("start").cast("long").alias("last_word"), F.collect_set("label").alias("base_set"))
    )


def _blocks_met(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per row with a block that meets a notice: the labels and the largest share."""
    own = Window.partitionBy("row", "template")
    rare_at = F.when(F.col("rare"), F.col("at"))
    near = (
        hits.join(tokens.filter("once"), "word")
        .filter(F.array_contains("templates", F.col("template")))
        .select("*", F.min(rare_at).over(own).alias("lo"), F.max(rare_at).over(own).alias("hi"))
        .filter((F.col("at") > F.col("lo") - F.col("length"))
                & (F.col("at") < F.col("hi") + F.col("length")))
        .select("*", F.size(F.collect_set("word").over(own)).alias("reach"))
        .filter("reach >= need")
    )
    before = F.lag("at").over(Window.partitionBy("row", "template", "word").orderBy("at"))
    after = F.coalesce(before + 1, F.lit(0))
    first = F.greatest(after, F.col("at") - F.col("length") + 1).alias("first")
    ends = F.explode(F.array(
        F.struct(F.col("first").alias("place"), F.lit(1).alias("step")),
        F.struct((F.col("at") + 1).alias("place"), F.lit(-1).alias("step")),
    ))
    per = ["row", "template", "label", "distinct_words", "need"]
    line = own.orderBy("place", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        near.select(*per, "at", first).select(*per, ends.alias("end")).select(*per, "end.place", "end.step")
        .select(*per, F.sum("step").over(line).alias("words"))
        .groupBy(*per).agg(F.max("words").alias("most")).filter("most >= need")
        .groupBy("row").agg(F.collect_set("label").alias("more_set"),
                            F.max(F.col("most") / F.col("distinct_words")).alias("share"))
    )
