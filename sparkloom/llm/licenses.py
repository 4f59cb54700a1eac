r"""License scans by diagonal voting, in DataFrame operations only.

All word pairs of a text are hashed and joined to the pairs of license phrases
and notices; a pair's words confirm its hash. A match votes for the diagonal on
which it lies: its place in the text less its place in the template. A base
phrase whose pairs all vote for one diagonal stands there word for word.
Neighbouring diagonals are merged, which bridges words put in or left out: where
they cover at least ``COVERED`` of the pairs of a template of three pairs or
more, its label is added.

The templates are fixed and few, so they are broadcast. Each text is exploded
and joined within one stage; only votes are shuffled, once, by row.

Defined results: a null text counts as empty; a text without words has n_words
0, no places, empty labels and score 0; repeated rows get a result each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Well-known sentences of licenses.
NOTICES = [
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]
COVERED, NEAR = 0.75, 2
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_pairs() -> list[tuple]:
    """(template, label, base, pairs in it, place, first word, second word)"""
    out = []
    for k, (phrase, label) in enumerate(PHRASES + NOTICES):
        w = phrase.split()
        out += [(k, label, k < len(PHRASES), len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return out


def votes(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A row for each matched pair, and one for each text with no template: doc_id, tag, n_words, template, ..., diagonal, place."""
    spark = docs.sparkSession
    pairs = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, template_pairs()))} AS t(template, label, base, pairs, place, first, second)")
    # the row of no template meets every text at place -1
    none = spark.sql("SELECT -1 AS template, CAST(NULL AS STRING) AS label, false AS base, 0 AS pairs, 0 AS place, CAST(NULL AS STRING) AS first, CAST(NULL AS STRING) AS second, 0L AS h")
    wanted = pairs.withColumn("h", F.xxhash64("first", "second")).unionByName(none)
    # lower() would also make the Kelvin sign a k, which templates have
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.filter(F.split(lowered, BETWEEN), lambda w: w != "")
    split = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("tag"), words.alias("words"))
    hashes = F.when(F.size("words") > 1, F.transform(F.slice("words", F.lit(2), F.size("words") - 1), lambda w, i: F.xxhash64(F.col("words")[i], w))).otherwise(F.array().cast("array<bigint>"))
    # made before they are exploded, so that explosion and join compile into one loop that copies no words
    made = split.withColumn("hashes", F.concat(F.array(F.lit(0).cast("long")), hashes))
    each = made.select("doc_id", "tag", "words", F.size("words").cast("long").alias("n_words"), F.posexplode("hashes").alias("at", "hash"))
    here = (F.col("hash") == F.col("h")) & (
        ((F.col("template") < 0) & (F.col("at") == 0))
        | ((F.col("template") >= 0) & (F.col("at") > 0) & (F.try_element_at("words", F.greatest("at", F.lit(1))) == F.col("first")) & (F.try_element_at("words", F.col("at") + 1) == F.col("second")))
    )
    return each.join(F.broadcast(wanted), here).select("doc_id", "tag", "n_words", "template", "label", "base", "pairs", "place", (F.col("at") - 1 - F.col("place")).cast("long").alias("diagonal"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    by_row = votes(docs, text, doc_id).repartition("tag")
    row = ["tag", "doc_id", "n_words"]
    diagonals = by_row.groupBy(*row, "template", "label", "base", "pairs", "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("met"))
    near = Window.partitionBy("tag", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    spans = diagonals.withColumn("covered", F.when(F.col("template") >= 0, F.bit_count(F.bit_or("met").over(near)) / F.col("pairs")).otherwise(0.0))
    exact = F.col("base") & (F.bit_count("met") == F.col("pairs"))
    added = exact | ((F.col("pairs") >= 3) & (F.col("covered") >= COVERED))
    place = F.when(exact, F.col("diagonal"))
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy(*row).agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(added).alias("labels"),
        F.max(F.when(exact, 1.0).when(F.col("pairs") >= 3, F.col("covered")).otherwise(0.0)).alias("score"),
    ).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
