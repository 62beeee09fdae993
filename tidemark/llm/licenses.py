"""License texts in documents, by diagonal voting over rolling word hashes.

All k-word hashes of a document are joined with the places where templates have them. A template quoted in a document
gives hits with one difference of places, its diagonal; edits move the rest to neighbouring diagonals.
Votes are counted per diagonal, neighbouring diagonals are merged, and a span is verified by its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.words import folded_words, lower_ascii
from tidemark.session import write_through

#: Fixed phrases and labels; every consecutive occurrence of the words counts.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words of a hash; diagonals this near are one; the share of a template's words that a span must hold, and the
#: words below which it must hold them all, as short notices differ in a single word.
GRAM, NEAR, COVERED, SHORT = 2, 4, 0.6, 12


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    base: bool = False


#: Notices and opening passages of public licenses, as their stewards publish them for inclusion.
TEMPLATES = tuple(Template(p, label, p, True) for p, label in PHRASES.items()) + (
    Template("mit-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
             "files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
             "distribute, sublicense, and/or sell copies of the Software"),
    Template("mit-notice", "mit", "Released under the MIT License"),
    Template("apache-2-notice", "apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-2-notice", "gpl-2", "GNU General Public License, version 2"),
    Template("gpl-3-notice", "gpl-3", "GNU General Public License, version 3"),
    Template("gpl-grant", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("lgpl", "lgpl", "GNU Lesser General Public License"),
    Template("agpl", "agpl", "GNU Affero General Public License"),
    Template("bsd-grant", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met"),
    Template("mpl-2-notice", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "cc-by", "Licensed under a Creative Commons Attribution License"),
    Template("cc-by-nc", "cc-by-nc", "Licensed under CC BY-NC"),
    Template("cc-by-sa", "cc-by-sa", "Licensed under CC BY-SA"),
    Template("isc-grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(template, tpos, words of the gram, length); a fixed list whose size does not depend on any input."""
    rows = []
    for i, t in enumerate(templates):
        words = [w.decode() for w in folded_words(t.text.encode())]
        if len(words) < k:
            raise ValueError(f"template {t.name} has fewer than {k} words")
        rows += [(i, p, " ".join(words[p:p + k]), len(words)) for p in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "template int, tpos int, tgram string, tlen int")
    return df.withColumn("h", F.xxhash64("tgram"))


def word_list(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for NULL."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def hits(docs: DataFrame, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(id, body, template, tlen, tpos, pos): places where a document has a k-gram of a template, told by hash and then by its words.

    ``docs``: id, body and words. The template side is a fixed table of some hundred rows, so it is broadcast
    and the k-grams of the corpus are joined where they are read.
    """
    grams = template_grams(docs.sparkSession, templates, k)
    each = F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.concat_ws(" ", *[F.get(F.col("words"), i + j) for j in range(k)]))
    rolled = docs.select("id", "body", F.posexplode(F.when(F.size("words") >= k, each)).alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    found = rolled.join(F.broadcast(grams), "h")
    return found.where("gram = tgram").select("id", "body", "template", "tlen", "tpos", "pos")


def spans(found: DataFrame, near: int = NEAR, covered: float = COVERED) -> DataFrame:
    """(id, body, template, start, stop, score) of verified spans.

    Votes of a diagonal are counted first; of its hits only one place of the template counts once. Diagonals no
    more than ``near`` apart are one chain. A copy drifts by no more than its template's length, so a chain that spreads over more
    diagonals is cut into overlapping bands of twice that length, and hits strewn over a long document make no span; a copy
    in two bands is found in both. A span is verified if its hits hold the share ``covered`` of the template's words.
    Rows per document are bounded by its hits.
    """
    doc = ["id", "body", "template"]
    votes = found.distinct().withColumn("diagonal", F.col("pos") - F.col("tpos"))
    line = W.partitionBy(*doc).orderBy("diagonal", "pos")
    jump = (F.col("diagonal") - F.lag("diagonal").over(line) > near) | F.lag("diagonal").over(line).isNull()
    grouped = votes.withColumn("_g", F.sum(jump.cast("int")).over(line))
    band = F.floor((F.col("diagonal") - F.min("diagonal").over(W.partitionBy(*doc, "_g"))) / F.col("tlen"))
    banded = grouped.withColumn("_b", band).withColumn("_b", F.explode(F.array_distinct(F.array("_b", F.greatest(F.col("_b") - 1, F.lit(0))))))
    per = banded.groupBy(*doc, "tlen", "_g", "_b").agg(
        F.min("pos").alias("start"), F.max("pos").alias("_end"), F.countDistinct("tpos").alias("votes"))
    share = (F.col("votes") + GRAM - 1) / F.col("tlen")
    return per.select(*doc, "start", (F.col("_end") + GRAM).alias("stop"), F.least(share, F.lit(1.0)).alias("score"), "tlen") \
        .where(F.col("score") >= F.when(F.col("tlen") < SHORT, 1.0).otherwise(covered)).drop("tlen")


def phrases(found: DataFrame, base: list[int]) -> DataFrame:
    """(id, body, template, start): whole phrases, i.e. diagonals of the base templates with every one of their grams."""
    rows = found.where(F.col("template").isin(base)).distinct()
    return (rows.groupBy("id", "body", "template", (F.col("pos") - F.col("tpos")).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.first("tlen").alias("tlen"))
            .where(F.col("n") == F.col("tlen") - GRAM + 1).select("id", "body", "template", "start"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    Base columns count whole phrases; ``labels`` adds those of verified template spans; both lists are distinct,
    sorted and joined by commas. The score is 1 with a whole phrase, else the best share of a verified span, else
    0. Rows that share an id are told apart by their texts; NULL and empty texts have no words. A
    label depends on the fixed template list, never on other documents.
    """
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("body"), word_list(F.col(f"`{text}`")).alias("words"))
    found = write_through(hits(d, templates), "hits")  # few rows, read twice
    base = [i for i, t in enumerate(templates) if t.base]
    labels = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    whole = phrases(found, base).select("id", "body", F.lit(True).alias("base"), F.col("start"), F.lit(1.0).alias("score"), labels.alias("label"))
    more = spans(found.where(~F.col("template").isin(base))).select("id", "body", F.lit(False).alias("base"), F.lit(None).cast("int").alias("start"), "score", labels.alias("label"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  of the fixed labels
    per = whole.unionByName(more).groupBy("id", "body").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max("score").alias("score"))
    all_rows = d.select("id", "body", F.size("words").cast("long").alias("n_words"))
    joined = all_rows.join(per.withColumnsRenamed({"id": "_id", "body": "_body"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    return joined.select("id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                         F.coalesce("score", F.lit(0.0)).alias("score"))
