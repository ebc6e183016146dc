"""License scans by diagonal voting.

All rolling pairs of words of the texts are joined, by hash, to the positions of
the same pairs in license templates. A hit votes for the diagonal text position
minus template position. Diagonals of one text and template that lie close to each
other are merged, which bridges inserted and left-out words, and a merged span
counts when enough of the template's pairs occur in it. Phrases are templates of
two to four words that must occur unbroken.

The templates are a fixed list of a few hundred words, which bounds the broadcast.
A null or empty text has no words and no labels. Rows are told apart by id and
text, so that repeated rows get the same result each; null ids are ids like
others; extra columns are not looked at; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases and their labels, whose places make the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening passages of public licenses and usual notices, with labels of our own.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
                "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                "sublicense, and/or sell copies of the Software",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                  "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
A_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: diagonals this close belong to one span
NEAR = 3
#: share of a template's pairs that a span must hold, and its longest length in template lengths
COVERAGE, STRETCH = 0.75, 1.5


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. The Kelvin sign, whose lower case is an ASCII
    letter, is put out of the way, as only A-Z are to change into ASCII."""
    body = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e6"))
    return F.array_remove(F.split(F.lower(body), NO_WORD), "")


def _pairs(words: Column) -> Column:
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def template_pairs(spark: SparkSession, templates: dict[str, str], phrases: dict[str, str]) -> DataFrame:
    """A row for each pair of words of each template: its hash, place and template."""
    listed = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for label, t in templates.items()]
    values = spark.createDataFrame(listed, "template string, label string, exact boolean")
    w = values.withColumn("words", words_of(F.col("template")))
    p = w.select("template", "label", "exact", (F.size("words") - 1).alias("needed"), F.posexplode(_pairs(F.col("words"))).alias("place", "pair"))
    return p.where(F.col("pair.b").isNotNull()).select(
        F.xxhash64("pair.a", "pair.b").alias("hash"), F.col("pair.a").alias("ta"), F.col("pair.b").alias("tb"), F.col("place").cast("long").alias("place"), "template", "label", "exact", "needed")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Verified spans: ``key``, ``__mark`` (hash of the text), label, exact, first and last
    (word positions), coverage. One row for each place and template."""
    known = template_pairs(docs.sparkSession, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    rolled = docs.select(F.col(key).alias("__id"), F.xxhash64(F.col(text)).alias("__mark"), F.posexplode(_pairs(words_of(F.col(text)))).alias("at", "pair"))
    rolled = rolled.where(F.col("pair.b").isNotNull()).select("__id", "__mark", F.col("at").cast("long").alias("at"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    rolled = rolled.withColumn("hash", F.xxhash64("a", "b"))
    hits = rolled.join(F.broadcast(known), "hash").where((F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
    # copies of a row vote once: a hit is a text, a place in it and a place in a template
    of = ["__id", "__mark", "template", "label", "exact", "needed"]
    votes = hits.groupBy(*of, "at", "place").agg(F.lit(1).alias("__one")).withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy(*of, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), (F.max("at") + 1).alias("last"))
    whole = lines.where("exact AND size(places) = needed").select("__id", "__mark", "label", "exact", F.col("diagonal").alias("first"), "last", F.lit(1.0).alias("coverage"))
    own = Window.partitionBy("__id", "__mark", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > NEAR, F.lit(True)).cast("int")
    merged = (lines.where("NOT exact").withColumn("__new", apart).withColumn("__run", F.sum("__new").over(own))
              .groupBy(*of, "__run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hit"), F.min("first").alias("first"), F.max("last").alias("last")))
    coverage = F.col("hit") / F.col("needed")
    good = merged.where((coverage >= COVERAGE) & (F.col("last") - F.col("first") <= STRETCH * (F.col("needed") + 1)))
    return whole.unionByName(good.select("__id", "__mark", "label", "exact", "first", "last", coverage.alias("coverage"))).withColumnRenamed("__id", key)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(docs, key, text, templates, phrases).groupBy(F.col(key).alias("__id"), "__mark").agg(
        F.count_if("exact").alias("n_base"), F.min(F.when(F.col("exact"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("exact"), F.col("first"))).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("__base"), F.collect_set("label").alias("__all"), F.max("coverage").alias("score"))
    ids = docs.select(F.col(key).alias("__id"), F.xxhash64(F.col(text)).alias("__mark"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(A_WORD)).cast("long").alias("n_words"))
    both = ids.alias("d").join(found.alias("f"), F.col("d.__id").eqNullSafe(F.col("f.__id")) & (F.col("d.__mark") == F.col("f.__mark")), "left")
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))), ",")
    return both.select(F.col("d.__id").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                       joined("__base").alias("base_labels"), joined("__all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
