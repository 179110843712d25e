"""License scan by diagonal voting.

Every pair of consecutive words of every text meets, in a Spark join, the places
where the templates have that pair. A hit votes for the diagonal ``position in the
text - position in the template``. A short phrase stands where all its pairs vote
for one diagonal; of a long text neighbouring diagonals are merged into bands, so
that words added or left out do not hide it, and the best band is verified by its
coverage. A band starts at every diagonal with a vote, whatever stands around it.
Pairs meet by hash and are then compared word by word, so a vote is never wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.llm.common import keyed, words_of
from lumenweave.session import cut

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening or telling sentences of public licenses, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under a creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Templates may have so many words in all; the table of their pairs is broadcast.
MOST_TEMPLATE_WORDS = 100_000


def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    rows = [(text, label, exact, i, a, b, len(w) - 1) for texts, exact in ((phrases, True), (notices, False)) for text, label in texts.items() for w in [text.split()] for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    if len(rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"the templates have {len(rows)} pairs of words; more than {MOST_TEMPLATE_WORDS} are not broadcast")
    if any(len(text.split()) < 2 for text in {**phrases, **notices}):
        raise ValueError("a template has two words at least")
    table = spark.createDataFrame(rows, "template string, label string, exact boolean, at int, a string, b string, pairs int")
    return table.withColumn("h", F.xxhash64("a", "b"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, coverage: float = 0.8, drift: int = 8) -> DataFrame:
    """The verified spans: ``id, fp, template, label, exact, first_word, last_word, coverage``.

    ``phrases`` need every pair on one diagonal. Of ``notices``, a share of
    ``coverage`` of the pairs does, on a band of diagonals at most ``drift`` apart.
    Of bands that start within ``drift`` of each other the best is returned: the one of
    most pairs, then the shortest, then the first. Words count from 0; a null or empty
    text has none. ``fp`` tells texts under one id apart; a row that repeats id and
    text adds nothing.
    """
    templates = _templates(docs.sparkSession, phrases, notices)
    words = keyed(docs, id_col, text_col).select("id", "fp", words_of(F.col("text")).alias("w"))
    pairs = words.select("id", "fp", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, greatest(size(w), 1))").alias("b"))).alias("pos", "pair"))
    pairs = pairs.select("id", "fp", "pos", F.col("pair.a").alias("wa"), F.col("pair.b").alias("wb")).withColumn("h", F.xxhash64("wa", "wb"))
    # size checked in _templates
    votes = pairs.join(F.broadcast(templates), "h").where("wa = a AND wb = b").select("id", "fp", "template", "label", "exact", "pairs", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))

    key = ["id", "fp", "template", "label", "exact", "pairs"]
    # few pairs of words are a template's: written down once for both kinds of template
    lines = cut(votes.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    phrase = lines.where(F.col("exact") & (F.size("ats") == F.col("pairs"))).select("id", "fp", "template", "label", "exact", F.col("diagonal").alias("first_word"), (F.col("hi") + 1).alias("last_word"), F.lit(1.0).alias("coverage"))

    order = Window.partitionBy("id", "fp", "template").orderBy("diagonal")
    band, near = order.rangeBetween(0, drift), order.rangeBetween(-drift, drift)
    bands = lines.where(~F.col("exact")).withColumns({"found": F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(band)))), "first_word": F.min("lo").over(band), "last_word": F.max("hi").over(band) + 1})
    bands = bands.withColumn("coverage", F.col("found") / F.col("pairs")).where(F.col("coverage") >= coverage)
    mark = F.struct(F.col("found"), (F.col("first_word") - F.col("last_word")).alias("short"), (-F.col("diagonal")).alias("early"))
    notice = bands.withColumn("mark", mark).withColumn("best", F.max("mark").over(near)).where("mark = best")
    return phrase.unionByName(notice.select(*phrase.columns))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: its words, the places of the phrases, the labels and a score.

    ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` (the best coverage; 0 without a label).
    The options are those of :func:`license_spans`. Null and empty texts have 0
    words and empty labels. Rows that repeat id and text are each returned; other
    columns of ``docs`` are ignored; a null id is an id like any other.
    """
    spans = license_spans(docs, id_col, text_col, **options)
    base = F.col("exact")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(F.col("id").alias("_id"), F.col("fp").alias("_fp")).agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max("coverage").alias("score"),
    )
    rows = keyed(docs, id_col, text_col).select("id", "fp", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
