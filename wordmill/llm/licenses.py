"""License scans by an exact set-similarity join, by built-in expressions only.

Two kinds of findings:

* Places where the words of a short phrase stand one after the other.
* Text blocks that contain at least ``threshold`` of a template's distinct words. A block
  is a line, or a run of consecutive words, across lines, that is 1 / ``threshold`` times
  as long as the template; every such run of a text counts. Templates' words are ordered
  by their frequency over the whole corpus, rare ones first, and so are those of them
  that a block has. A block that contains c of a template's n words must contain one of
  the first n - c + 1 (the prefix). Prefix words and blocks' words are joined by equality;
  a pair goes on if the block has enough of the templates' words at all (length filter),
  and if enough of both come from the first common word on, by its places in the template
  and in the block (positional filter); then the overlap is counted exactly. So every
  block that meets the threshold is found. Runs of words are looked at only where the
  whole text passes this.

The templates are a parameter. What is made of them (the order of their words, prefixes)
is as large as the templates, whatever the corpus, and may be broadcast.

Words are runs of characters other than ASCII signs and spaces, with A-Z lower-cased.

Defined cases: a null text counts as empty; blocks without words match nothing; repeated
rows give a row each (by doc_id and a hash of the text, so equal rows have equal
findings); a null doc_id is kept; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm.shared import written

# What a word is (before and after lower-casing) and what separates words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases and labels of the base findings.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short license notices, and the passages by which the usual license bodies are known, by label.
TEMPLATES = {
    "notice-mit": "Released under the MIT License",
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0",
    "notice-gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "notice-cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "notice-cc-by-4.0": "Licensed under CC BY 4.0",
    "notice-bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "notice-reserved": "All rights reserved",
    "license-mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "license-bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "license-isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "license-apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "license-gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "license-mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "license-unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}
THRESHOLD = 0.8


def lowered(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def words_of(x: Column) -> Column:
    return F.regexp_extract_all(lowered(x), F.lit(WORD), F.lit(0))


def one_of(words: list[str]) -> str:
    """A pattern of any of the words as a whole word; common beginnings are tried once."""

    def tails(words: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in filter(None, words):
            heads.setdefault(w[0], []).append(w[1:])
        body = "|".join(c + tails(rest) for c, rest in sorted(heads.items()))
        return f"(?:{body})?" if heads and "" in words else f"(?:{body})" if len(heads) > 1 else body

    return rf"(?i)(?<![0-9A-Za-z\x{{80}}-\x{{10FFFF}}]){tails(words)}(?![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])"


def places(text: Column, phrases: dict[str, str]) -> Column:
    """array<struct<at int, label string>> of the phrases in a text."""
    none = F.array().cast("array<struct<at:int,label:string>>")
    hint = "|".join(SEPARATOR.join(p.split()) for p in phrases)

    def found(words: Column) -> Column:
        def of(phrase: str, label: str) -> Column:
            parts = phrase.split()

            def here(i: Column) -> Column:
                same = [F.get(words, i + k) == p for k, p in enumerate(parts)]
                out = same[0]
                for s in same[1:]:
                    out = out & s
                return F.coalesce(out, F.lit(False))

            return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), here), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

        return F.concat(*[of(p, label) for p, label in phrases.items()])

    return F.when(text.rlike(f"(?i)(?:{hint})"), F.get(F.transform(F.array(words_of(text)), found), F.lit(0))).otherwise(none)


def ordered_words(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The words of all templates by their frequency, rare ones first. Frequencies count every occurrence in all texts."""
    known = sorted({w for t in templates.values() for w in template_words(t)})
    if not known:
        return []
    # templates' words only are taken from the texts, so there is a row for each of these at most
    found = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(one_of(known)), F.lit(0))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["n"] for r in found.groupBy(lowered(F.col("word")).alias("word")).agg(F.sum("count").alias("n")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def template_words(template: str) -> list[str]:
    return re.findall(WORD, template.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def prefixes(spark: SparkSession, templates: dict[str, str], order: list[str], threshold: float) -> DataFrame:
    """(word, label, n, need, run, place, words, prefix): each template's prefix in an order of words.

    ``run`` is the length of the runs of words that are compared with the template.
    """
    rows = []
    for label, template in templates.items():
        every = template_words(template)
        words = sorted(set(every), key=order.index)
        need = math.ceil(threshold * len(words) - 1e-9)
        prefix = words[: len(words) - need + 1] if words else []
        rows += [(word, label, len(words), need, math.ceil(len(every) / threshold - 1e-9), place, words, prefix) for place, word in enumerate(prefix)]
    return spark.createDataFrame(rows, "word string, label string, n int, need int, run int, place int, words array<string>, prefix array<string>")


def best_run(words: Column, own: Column, run: Column) -> Column:
    """The most distinct words of ``own`` in ``run`` consecutive ones of ``words``; a best run begins with one of them."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(own, x["word"]))

    def most(hits: Column) -> Column:
        def distinct(x: Column, j: Column) -> Column:
            near = F.filter(F.slice(hits, j + 1, run), lambda y: y["at"] < x["at"] + run)
            return F.size(F.array_distinct(F.transform(near, lambda y: y["word"])))

        return F.array_max(F.transform(hits, distinct))

    return F.get(F.transform(F.array(hits), most), F.lit(0))


def similar_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, label, containment): the best block of each document for each template that reaches the threshold."""
    met = candidates(docs, templates, threshold)
    met = met.withColumn("both", F.size(F.array_intersect("ordered", "words"))).where(F.col("both") >= F.col("need"))
    both = F.when(F.col("whole"), best_run(F.col("all"), F.col("words"), F.col("run"))).otherwise(F.col("both"))
    return met.select("doc_id", "digest", "label", "need", "n", both.alias("both")).where(F.col("both") >= F.col("need")).groupBy("doc_id", "digest", "label").agg(F.max(F.col("both") / F.col("n")).alias("containment"))


def candidates(docs: DataFrame, templates: dict[str, str], threshold: float, positional: bool = True) -> DataFrame:
    """Blocks and templates that share a prefix word and pass the length and positional filters, each pair once."""
    order = ordered_words(docs, templates)
    table = prefixes(docs.sparkSession, templates, order, threshold)
    own = [r["word"] for r in table.select("word").distinct().collect()]  # words of the templates' prefixes
    least = table.agg(F.min("need")).first()[0] or 1
    pattern = one_of(own) if own else r"(?!)"
    listed = lambda words: F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    # a text's lines, and the whole of it for runs of words across lines
    block = lambda x, whole: F.struct(x.alias("block"), F.lit(whole).alias("whole"))
    cut = F.concat(F.transform(F.split("text", "\n", -1), lambda x: block(x, False)), F.array(block(F.col("text"), True)))
    lines = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.xxhash64("text").alias("digest"), F.explode(cut).alias("b")).select("doc_id", "digest", "b.block", "b.whole")
    lines = lines.where(~F.col("whole") | F.contains("block", F.lit("\n"))).where(F.col("block").rlike(pattern))
    # of a block only templates' words count, in their order
    bags = lines.select("doc_id", "digest", "whole", words_of(F.col("block")).alias("all")).withColumn("ordered", F.array_intersect(listed(order), "all")).where(F.size("ordered") >= least)
    probes = bags.withColumn("word", F.explode(F.array_intersect("ordered", listed(own))))
    met = probes.join(F.broadcast(table), "word").where(F.size("ordered") >= F.col("need"))
    # once for each block and template: by the first prefix word that the block has
    met = met.where(F.get(F.array_intersect("prefix", "ordered"), F.lit(0)) == F.col("word"))
    if not positional:
        return met
    # what both have from their first common word on bounds the overlap from above
    rest = F.least(F.col("n") - F.col("place"), F.size("ordered") - F.array_position("ordered", F.col("word")).cast("int") + 1)
    return met.where(rest >= F.col("need"))


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places, blocks (array<struct<label, containment>>) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = similar_blocks(docs, templates, threshold)
    near = near.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("label", "containment"))).alias("blocks"))
    near = written(spark, near, "blocks").select(F.col("doc_id").alias("of"), F.col("digest").alias("as"), "blocks")
    base = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), places(F.col("text"), phrases).alias("places"))
    return base.join(near, base["doc_id"].eqNullSafe(near["of"]) & (base["digest"] == near["as"]), "left").select(
        "doc_id", "n_words", "places", F.coalesce("blocks", F.array().cast("array<struct<label:string,containment:double>>")).alias("blocks")
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license findings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scanned(docs)
    at, label = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(label)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(label, F.transform("blocks", lambda b: b["label"])))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
