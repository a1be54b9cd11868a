"""License scan: an exact set-similarity join of text blocks with license templates.

A text block is a run of consecutive words, wherever lines break: for a template of n words, every run of WINDOW * n words
(rounded up, fewer at the end of a text). A template is found in a block that holds at least THRESHOLD of its distinct words.

Words of the templates are put in order of their frequency over all documents, rarest first. A document with such a block
holds one of the template's first few words (prefix), has enough of all words (length) and enough words left after the
shared one (position): these filters make the pairs of documents and templates, whose blocks are then counted exactly. A
block can be moved on to the next word of the template without losing any, so blocks that begin with one are enough. No Python.

A null or empty text has no words, no places and no labels; an empty table gives an empty table; repeated rows each get
their own answer. Texts are read whole; in a text that passes the filters, time grows with its words times a template's
length. Only doc_id and text are read by `license_digest`; `find_templates` keeps all columns but the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, materialize, wide_key, small_table, words_of

THRESHOLD, WINDOW = 0.9, 1.2
BROADCAST_ROWS = 500_000
#: Fixed by contract: phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and parts of license texts as commonly published, in plain words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """How many of a template's words a block must hold."""
    return math.ceil(threshold * size - 1e-9)


def width(template: str) -> int:
    """How many words a block for a template has."""
    return math.ceil(WINDOW * len(template.split()) - 1e-9)


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with the value computed once for all uses."""
    return F.transform(F.array(value), f)[0]


def _vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def word_frequencies(held: DataFrame) -> dict[str, int]:
    """In how many documents each word of the templates stands, over all of them; as many rows as the templates have words."""
    seen = held.select(F.explode("have").alias("word"))
    return {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _candidates(held: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(key, template) of documents that hold as many of a template's words as a block of them must. held: key and have."""
    df = word_frequencies(held)
    order = sorted(_vocabulary(templates), key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for i, (_, t) in enumerate(templates):
        ranks = sorted(rank[w] for w in set(t.split()))
        least = needed(len(ranks), threshold)
        rows += [(order[r], at, i, [order[x] for x in ranks], least) for at, r in enumerate(ranks[: len(ranks) - least + 1])]
    prefix = F.broadcast(small_table(held.sparkSession, rows, "word string, at int, template int, words array<string>, least int"))
    in_order = F.array(*map(F.lit, order))
    ranked = held.select("key", F.array_sort(F.transform("have", lambda w: F.struct(F.array_position(in_order, w).alias("rank"), w.alias("word")))).alias("have"))
    probes = ranked.select("key", F.transform("have", lambda x: x["word"]).alias("have"), F.posexplode("have").alias("pos", "x")).select("key", "have", "pos", F.col("x.word").alias("word"))
    left = F.least(F.size("have") - F.col("pos"), F.size("words") - F.col("at"))
    near = probes.join(prefix, "word").filter((F.size("have") >= F.col("least")) & (left >= F.col("least") - F.least("pos", "at")))
    return near.filter(F.size(F.array_intersect("have", "words")) >= F.col("least")).select("key", "template").distinct()


def _apart(places: Column, length: Column) -> Column:
    """Of places (pos, n, in order) that begin less than a length after the first of them the one of the largest n (of equals the
    first), then of those from there on, and so on."""
    one = lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"))
    none = F.struct(F.lit(None).cast("struct<pos:int,n:int>").alias("best"), F.lit(0).alias("since"), F.array().cast("array<struct<pos:int,n:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(one(x).alias("best"), x["pos"].alias("since"), F.when(acc["best"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["best"]))).alias("out"))
        same = F.struct(F.when(x["n"] > acc["best"]["n"], one(x)).otherwise(acc["best"]).alias("best"), acc["since"].alias("since"), acc["out"].alias("out"))
        return F.when(acc["best"].isNotNull() & (x["pos"] < acc["since"] + length), same).otherwise(new)

    return F.aggregate(places, none, step, lambda acc: F.when(acc["best"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["best"]))))


def _blocks(some: DataFrame, pairs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(key, template, label, first, containment) of every block that meets the threshold. some: key and words.

    Blocks begin at words of their template. Of those that overlap (that begin less than a template's length after the first one
    of them) the best one is returned, of equals the first; so copies of a notice that follow each other are blocks of their own.
    """
    rows = [(i, label, sorted(set(t.split())), needed(len(set(t.split())), threshold), width(t), len(t.split())) for i, (label, t) in enumerate(templates)]
    table = F.broadcast(small_table(some.sparkSession, rows, "template int, label string, tw array<string>, least int, width int, length int"))

    def all_blocks(at: Column) -> Column:
        def block(x: Column, k: Column) -> Column:
            inside = F.filter(F.slice(at, k + 1, F.col("width")), lambda y: y["pos"] < x["pos"] + F.col("width"))
            return F.struct(x["pos"].alias("pos"), F.size(F.array_distinct(F.transform(inside, lambda y: y["word"]))).alias("n"))

        return _apart(F.filter(F.transform(at, block), lambda x: x["n"] >= F.col("least")), F.col("length"))

    held = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.array_contains("tw", x["word"]))
    found = some.join(pairs, "key").join(table, "template").select("key", "template", "label", F.size("tw").alias("of"), F.explode(_let(held, all_blocks)).alias("block"))
    return found.select("key", "template", "label", F.col("block.pos").cast("long").alias("first"), (F.col("block.n") / F.col("of")).alias("containment"))


def _hits(docs: DataFrame, held: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """The blocks found, by wide_key of the text. held: key and have (the templates' words that a text holds), for every text."""
    pairs = materialize(_candidates(held, templates, threshold))
    keyed = docs.select(wide_key("text").alias("key"), "text")
    some = keyed.join(at_most(pairs.select("key").distinct(), BROADCAST_ROWS), "key", "left_semi").dropDuplicates(["key"])
    return _blocks(some.select("key", words_of(F.col("text")).alias("words")), pairs, templates, threshold)


def _have(words: Column, templates: list[tuple[str, str]]) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, _vocabulary(templates)))).alias("have")


def find_templates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs without the text, and for each row and block of a template in it (label, template, first, containment) as `found`.

    first is the word at which the block begins, from 0; see `_blocks` for blocks that overlap. The templates are a fixed list, so they are broadcast.
    """
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    held = materialize(texts.select(wide_key("text").alias("key"), _have(words_of(F.col("text")), templates)).filter(F.size("have") > 0).dropDuplicates(["key"]))
    hits = _hits(texts, held, templates, threshold).select(F.col("key").alias("__key"), F.struct("label", "template", "first", "containment").alias("found"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.withColumn("__key", wide_key(text)).join(hits, "__key").select(*kept, "found")


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels of both kinds and the best containment.

    Texts are split into words once; what the counts and the join need of them is written down.
    """
    texts = docs.select("doc_id", "text")
    split = texts.select("doc_id", wide_key("text").alias("key"), words_of(F.col("text")).alias("words"))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    phrases = "(?<= )(?=(?:" + "|".join(BASE) + ") )"
    plain = split.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), _have(F.col("words"), TEMPLATES), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("plain"))
    found = [F.when(F.col("plain").contains(f" {p} "), F.lit(label)) for p, label in BASE.items()]
    # each piece but the first starts with a phrase; words of one piece are counted by its blanks
    pieces = F.when(F.col("plain").rlike(phrases), F.split("plain", phrases, -1)).otherwise(F.array("plain"))
    counted = materialize(plain.select(
        "doc_id", "key", "n_words", "have", F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("base"),
        _let(pieces, lambda p: F.struct((F.size(p) - 1).cast("long").alias("n"), (blanks(p[0]) - 1).cast("long").alias("before"), blanks(F.element_at(p, -1)).cast("long").alias("after"))).alias("at"),
    ))
    held = counted.select("key", "have").filter(F.size("have") > 0).dropDuplicates(["key"])
    hits = _hits(texts, held, TEMPLATES, THRESHOLD).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    n = F.col("at.n")
    score = F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return counted.join(at_most(materialize(hits), BROADCAST_ROWS), "key", "left").select(
        "doc_id", "n_words", n.alias("n_base"), F.when(n > 0, F.col("at.before")).alias("first_word"), F.when(n > 0, F.col("n_words") - F.col("at.after")).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(score, 6).alias("score"),
    )
