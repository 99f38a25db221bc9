"""License notices found by voting on diagonals, in DataFrame functions only.

Templates are phrases and whole notices. Every place of a text gives the hash of
its next words; one equi-join meets them with the places of all templates, and the
words themselves confirm each meeting. A meeting votes for a template and a
diagonal, the offset between both places. Votes are counted per diagonal; diagonals
of one template closer than a tenth of its length are one candidate, so words may be
missing or added. A candidate holds if the words it confirms cover most of its
template and of its own span.

A text is named by its digest: copies vote alike, and an aggregate merges their votes
before anything else, so that a notice over a third of all rows is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dasyspark.llm.common import join_small
from dasyspark.session import materialize

WIDTH = 3  # words of a gram; shorter templates are one gram
LEAST_COVER = 0.8
SLACK = 10  # diagonals within a tenth of the template's length are neighbours

# Labels and words of phrases.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Openings of public notices and usual one-line forms.
NOTICES = (
    ("agpl", "GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Released under the BSD License"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under CC0"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All ASCII but letters and digits, one by one: the JVM keeps such a class as a bit set, six times faster than ranges.
_BREAKS = "".join(f"\\x{b:02x}" for b in range(128) if not chr(b).isalnum())


def words(text: Column) -> Column:
    """Runs of letters a-z (A-Z lower-cased), digits and everything beyond ASCII."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"[^{_BREAKS}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_BREAKS}]+")), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    """Sixteen bytes that name a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def templates(spark: SparkSession, rows=None) -> DataFrame:
    """``template, label, base, words``; ``rows`` are (label, text, whether it is one of the base phrases)."""
    rows = [*((*p, True) for p in PHRASES), *((*n, False) for n in NOTICES)] if rows is None else rows
    given = [(i, label, text, base) for i, (label, text, base) in enumerate(rows)]
    made = spark.createDataFrame(given, "template int, label string, text string, base boolean")
    return made.withColumn("words", words(F.col("text"))).drop("text").where(F.size("words") > 0)


def _grams(df: DataFrame, keep: list[str], place: str) -> DataFrame:
    """A row for each place: its word and, where there are such, the next two."""
    ahead = [F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))) for k in range(1, WIDTH)]
    zipped = df.where(F.size("words") > 0).select(*keep, F.posexplode(F.arrays_zip("words", *ahead)).alias(place, "_g"))
    return zipped.select(*keep, place, *[F.col("_g").getField(name).alias(f"w{k}") for k, name in enumerate(["words", "1", "2"])])


def _hash(width: int) -> Column:
    """Hash of the first ``width`` words; null where the text ends before."""
    return F.when(F.col(f"w{width - 1}").isNotNull(), F.xxhash64(*[F.col(f"w{i}") for i in range(width)]))


def template_grams(kinds: DataFrame) -> DataFrame:
    """Every gram of every template: its width (three words, or a shorter template whole), hash and words."""
    sized = kinds.withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(WIDTH)))
    placed = _grams(sized, ["template", "n", "k"], "at").where(F.col("at") <= F.col("n") - F.col("k"))
    by_width = F.element_at(F.array(*[_hash(w) for w in range(1, WIDTH + 1)]), F.col("k"))
    past = [F.when(F.col("k") > i, F.col(f"w{i}")).alias(f"t{i}") for i in range(WIDTH)]
    return placed.select("template", "n", "k", "at", by_width.alias("h"), *past)


def votes(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``node, template, n, k, diagonal, ats``: the template's places confirmed on each diagonal of each distinct text."""
    grams = materialize(template_grams(kinds), "templates")
    widths = sorted(r["k"] for r in grams.select("k").distinct().collect())  # three at most
    cut = docs.where(F.length("text") > 0).select(digest(F.col("text")).alias("node"), words(F.col("text")).alias("words"))
    places = _grams(cut, ["node"], "pos")
    hashes = {f"h{w}": _hash(w) for w in widths}
    hashed = places.withColumns(hashes).unpivot([*places.columns], [*hashes], "width", "h") if widths else places.withColumn("h", _hash(1))
    met = join_small(hashed.where(F.col("h").isNotNull()), grams, "h", "inner", 200)
    same = [F.col(f"t{i}").isNull() | (F.col(f"w{i}") == F.col(f"t{i}")) for i in range(WIDTH)]
    met = met.where(same[0] & same[1] & same[2])
    return met.groupBy("node", "template", "n", "k", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats")  # no more than a template has places
    )


def spans(docs: DataFrame, kinds: DataFrame, least: float = LEAST_COVER) -> DataFrame:
    """``node, template, start, length, cover``: accepted places of templates in each distinct text (``digest``), in words.

    ``cover`` is the number of template words confirmed over the longer of template and span.
    Overlapping places of different templates all stay.
    """
    from pyspark.sql import Window

    line = Window.partitionBy("node", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(line)
    found = votes(docs, kinds).withColumn("_new", F.when(step * SLACK <= F.col("n"), 0).otherwise(1))
    found = found.withColumn("_group", F.sum("_new").over(line))
    covered = F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))
    merged = found.groupBy("node", "template", "n", "_group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(covered))))).alias("_covered"),
        F.min(F.col("diagonal") + F.array_min("ats")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("ats") + F.col("k")).alias("_end"),
    )
    length = F.col("_end") - F.col("start")
    judged = merged.select(
        "node", "template", F.col("start").cast("long").alias("start"), length.cast("long").alias("length"),
        (F.col("_covered") / F.greatest(F.col("n"), length)).alias("cover"),
    )
    return judged.where(F.col("cover") >= least)


RESULT = ("n_words", "licenses", "score")
LICENSE = "array<struct<label:string,base:boolean,start:bigint,length:bigint,cover:double>>"


def scan(docs: DataFrame, kinds: DataFrame | None = None, least: float = LEAST_COVER) -> DataFrame:
    """``docs`` with ``n_words``, ``licenses`` and ``score``.

    ``licenses``: an array of (label, base, start, length, cover), empty where nothing is
    found; ``score`` is the best cover, 0 without any. A null or blank text has no words.
    Rows are judged by their text alone, so repeated rows and rows without id give what
    their text gives; an empty table an empty one. Columns named as the results, or
    ``node``, are replaced.
    """
    kinds = templates(docs.sparkSession) if kinds is None else kinds
    kept = docs.select(*[c for c in docs.columns if c not in (*RESULT, "node")])
    # Labels come by a join of the few templates.
    named = spans(kept, kinds, least).join(F.broadcast(kinds.select("template", "label", "base")), "template")
    per_text = named.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "label", "base", "cover"))).alias("_found")
    )
    shown = F.transform("_found", lambda s: F.struct(s["label"].alias("label"), s["base"].alias("base"), s["start"].alias("start"), s["length"].alias("length"), s["cover"].alias("cover")))
    per_text = materialize(per_text.select("node", shown.alias("licenses")), "licenses")
    named_docs = kept.withColumns({"node": digest(F.col("text")), "n_words": word_count(F.col("text"))})
    joined = join_small(named_docs, per_text, "node", "left", 400).drop("node")
    listed = F.coalesce(F.col("licenses"), F.array().cast(LICENSE))
    best = F.aggregate(listed, F.lit(0.0), lambda a, s: F.greatest(a, s["cover"]))
    return joined.withColumns({"licenses": listed, "score": best}).select(*kept.columns, *RESULT)
