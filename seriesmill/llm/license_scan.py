"""License scan by an exact set-similarity join against notice templates (DataFrame functions only).

Base: places where a license phrase's words stand consecutively. Method: a block is a run of as many words as a template
has, anywhere in a text, across line breaks; every block that holds at least ``percent`` % of the template's distinct
words is found. Template words are ordered by how many documents of the corpus hold them, rarest first. A block that
reaches a template holds one of the template's first n - need + 1 words (prefix filter), so the places of these words are
joined with the templates that have them there. From the first common word on in that order, the words around the place
must still hold ``need`` of the template's (length and positional filter); what passes is counted block by block. Of
blocks that overlap, the one that holds most of its template stays (the longer of equals, then the earlier), so a notice
is one block with one label.

Words are runs of ASCII digits, letters (A-Z lowered) and non-ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Phrases whose consecutive words give the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice templates of the similarity join: well-known notices and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the mozilla public license version 2 0", "mpl-2"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
    ("all rights reserved no part of this text may be reproduced without permission", "all-rights-reserved"),
)
PERCENT = 80
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Lowered words of a text, each gap one blank, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAP, " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _list(norm: str) -> Column:
    return F.split(F.trim(norm), " ")


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words by the number of documents that hold them, rarest first; ``docs`` has a column norm.

    One count a word of the templates comes to the driver.
    """
    df = dict(docs.select(F.explode(F.array_intersect(_strings(vocabulary), _list("norm"))).alias("w")).groupBy("w").count().collect())
    return sorted(vocabulary, key=lambda w: (df.get(w, 0), w))


def _prefixes(order: list[str], templates, percent: int) -> list[tuple]:
    """(w, r, words, label, n, need, size) for each word of each template's prefix: r words come before it in order."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for text, label in templates:
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = -(-len(words) * percent // 100)
        out += [(words[r], r, words, label, len(words), need, len(text.split())) for r in range(len(words) - need + 1)]
    return out


def blocks(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, a, b, first_word, label, score): the blocks found in ``docs`` (doc_id, norm, and a and b, hashes of the text)."""
    spark, reach = docs.sparkSession, max(len(t.split()) for t, _ in templates)
    rows = _prefixes(word_order(docs, sorted({w for t, _ in templates for w in t.split()})), templates, percent)
    prefixes = spark.createDataFrame(rows, "w string, r int, words array<string>, label string, n int, need int, size int")
    heads = sorted({x[0] for x in rows})
    # the words of a text are named once (ws), so that each place takes its surroundings from them and none is split again
    found = F.transform(
        F.array(_list("norm")),
        lambda ws: F.filter(
            F.transform(ws, lambda w, i: F.when(w.isin(heads), F.struct(w.alias("w"), F.greatest(i - (reach - 1), F.lit(0)).alias("lo"), i.alias("at"), F.slice(ws, F.greatest(i - (reach - 1), F.lit(0)) + 1, F.lit(2 * reach)).alias("near")))),
            lambda x: x.isNotNull(),
        ),
    )
    places = docs.where(F.arrays_overlap(_list("norm"), _strings(heads))).select("doc_id", "a", "b", F.explode(found[0]).alias("x")).select("doc_id", "a", "b", "x.*")
    met = places.join(prefixes, "w").withColumn("at", F.col("at") - F.col("lo"))
    around = "slice(near, greatest(at - size + 1, 0) + 1, least(at, size - 1) + size)"
    met = met.where(f"size(array_intersect(slice(words, r + 1, n), {around})) >= need")
    window = "slice(near, j + 1, size)"
    # a block starts with a word of the template, and is counted at the first place of the first common word in it
    test = f"array_contains(words, near[j]) and array_position({window}, w) = at - j + 1 and not arrays_overlap(slice(words, 1, r), {window})"
    hits = met.select("doc_id", "a", "b", "lo", "label", "n", "need", "size", F.explode(F.expr(f"transform(filter(sequence(greatest(at - size + 1, 0), at), j -> {test}), j -> struct(j as j, size(array_intersect(words, {window})) as held))")).alias("x"))
    hits = hits.where("x.held >= need").select("doc_id", "a", "b", "label", (F.col("lo") + F.col("x.j")).alias("first_word"), "n", "size", (F.col("x.held") / F.col("n").cast("double")).alias("score")).distinct()
    # a hit stays if it is the best at each of its words
    hits = hits.withColumn("rank", F.struct("score", "n", (-F.col("first_word")).alias("s"), "label", "size"))
    at_word = hits.select("doc_id", "a", "b", "rank", F.explode(F.expr("sequence(first_word, first_word + size - 1)")).alias("p"))
    best = at_word.withColumn("best", F.max("rank").over(W.partitionBy("doc_id", "a", "b", "p")))
    kept = best.groupBy("doc_id", "a", "b", "rank").agg(F.bool_and(F.col("rank") == F.col("best")).alias("ok")).where("ok")
    return kept.select("doc_id", "a", "b", (-F.col("rank.s")).alias("first_word"), "rank.label", "rank.score")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, templates=TEMPLATES) -> DataFrame:
    """Licenses of each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks, blocks.

    n_base counts all places of all phrases; first_word and last_word are their smallest and largest start (words from 0;
    null without any). ``labels`` adds blocks' labels to the base ones; both are distinct, sorted and joined by commas, ""
    for none. ``score`` is the best containment, 1 where a phrase stands, else 0. ``blocks`` has first word, label and score
    of each block that stays, in order, and n_blocks their number. ``templates`` is a table of (words, label), any number
    of them. A null text counts as empty (0 words); repeated rows and null doc_ids are scanned each; texts may have any
    length; other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = own.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), _words(F.col("text")).alias("norm"))
    n_words = F.when(F.col("norm") == "  ", 0).otherwise(_blanks(F.col("norm")) - 1).cast("long")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        seen, back = F.instr("norm", f" {phrase} "), f" {phrase} "[::-1]
        counts.append(F.when(seen > 0, F.regexp_count("norm", F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(seen > 0, _blanks(F.expr(f"left(norm, instr(norm, ' {phrase} '))")) - 1))
        lasts.append(F.when(seen > 0, _blanks(F.expr(f"left(norm, length(norm) - instr(reverse(norm), '{back}') - {len(back)} + 2)")) - 1))
        labels.append(F.when(seen > 0, F.lit(label)))
    told = base.select(
        "doc_id", "a", "b", n_words.alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.array_min(F.array(*firsts)).cast("long").alias("first_word"),
        F.array_max(F.array(*lasts)).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"),
    )
    found = blocks(base, templates, percent).groupBy("doc_id", "a", "b").agg(F.sort_array(F.collect_list(F.struct("first_word", "label", "score"))).alias("blocks"))
    found = found.select(F.col("doc_id").alias("i"), F.col("a").alias("x"), F.col("b").alias("y"), "blocks")
    none = F.array().cast("array<struct<first_word:int,label:string,score:double>>")
    out = told.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left").withColumn("blocks", F.coalesce("blocks", none))
    every = F.array_sort(F.array_distinct(F.concat("base", F.col("blocks.label"))))
    top = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.score"), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), top.alias("score"), F.size("blocks").cast("long").alias("n_blocks"), "blocks")
