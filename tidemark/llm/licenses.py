"""License scans: phrases by their places, and an exact set-similarity join with license templates
(DataFrame functions only).

The text blocks of a document are its windows of twice a template's width, one after each width, so
that every run of words as long as the template lies in one of them whole. A block meets a template
if it contains THRESHOLD of the template's distinct words. All templates' words are ordered by
their frequency over the corpus, rarest first. A block that meets a template must hold one of its
first words in this order (prefix filter), enough of the templates' words at all (length filter),
and enough of them from the word on by which it was found (positional filter); only blocks that
pass are compared with the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a word is, in Java's and RE2's spelling, and the phrases of the base labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Wordings by which licenses are granted or named, as words.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Of a template's distinct words a block holds so many hundredths at least.
THRESHOLD = 90


def needed(words: int, threshold: int = THRESHOLD) -> int:
    """Distinct words of a template of so many that a block must hold."""
    return -(-words * threshold // 100)


def width(words: int) -> int:
    """The stride of the blocks for a template of so many words: the next power of two, 8 at least."""
    return max(8, 1 << (words - 1).bit_length())


def _words(text: Column) -> Column:
    """Words with A-Z in lower case. Of other letters only the Kelvin sign becomes one of a-z in lower case, so it is set aside."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _said(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), _words(text).alias("words"))


def frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """word, n: how many documents hold each word of the templates (those of none are left out)."""
    known = sorted({w for _, t in templates for w in t.split()})
    return docs.select(F.explode(F.array_intersect(_words(F.col(text_col)), _said(known))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _index(docs: DataFrame, text_col: str, templates, threshold: int):
    """(rows word, rank, template, label, ranks, at, need, width) of the templates' first words, and each word's rank.
    As many rows as the templates have words at most, however large the corpus is."""
    seen = dict(map(tuple, frequencies(docs, text_col, templates).collect()))
    order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for k, (label, said) in enumerate(templates):
        ranks = sorted({rank[w] for w in said.split()})
        need = needed(len(ranks), threshold)
        rows += [(order[r], r, k, label, ranks, at, need, width(len(said.split()))) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    return rows, rank


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """id, text_hash, label, template (its place in templates), first_word, n_words, contained of every
    block that meets a template, each once for equal ids and texts. contained is the share of the
    template's distinct words that the block holds."""
    rows, rank = _index(docs, text_col, templates, threshold)
    if not rows:
        raise ValueError("no templates")
    index = docs.sparkSession.createDataFrame(rows, "word string, rank int, template int, label string, ranks array<int>, at int, need int, width int")
    places = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    first = {w: _said(sorted({r[0] for r in rows if r[7] == w})) for w in sorted({r[7] for r in rows})}
    found = _rows(docs, id_col, text_col)
    # of each width only if a first word of its templates is there; then a block's own words alone go on
    widths = F.array_compact(F.array(*[F.when(F.arrays_overlap("words", known), F.lit(w)) for w, known in first.items()]))
    found = found.select("id", "text_hash", "words", F.explode(widths).alias("width"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / F.col("width")).cast("int")), lambda k: F.slice("words", k * F.col("width") + 1, 2 * F.col("width")))
    found = found.select("id", "text_hash", "width", F.posexplode(blocks).alias("block", "inside"))
    met = F.lit(False)
    for w, known in first.items():
        met = F.when(F.col("width") == w, F.arrays_overlap("inside", known)).otherwise(met)
    found = found.where(met).select("id", "text_hash", "width", "block", F.size("inside").alias("n_words"), F.array_intersect("inside", _said(rank)).alias("words"))
    held = F.array_sort(F.transform("words", lambda w: F.element_at(places, w)))
    found = found.select("*", held.alias("held")).withColumn("word", F.explode("words")).join(F.broadcast(index), ["word", "width"])
    found = found.where(F.size("held") >= F.col("need"))
    rest = F.least(F.size("ranks") - F.col("at") - 1, F.size("held") - F.array_position("held", F.col("rank")).cast("int"))
    found = found.where(rest + 1 >= F.col("need"))
    shared = F.size(F.array_intersect("held", "ranks"))
    found = found.where(shared >= F.col("need")).withColumn("contained", shared / F.size("ranks"))
    key = ["id", "text_hash", "label", "template", (F.col("block") * F.col("width")).cast("long").alias("first_word"), F.col("n_words").cast("long").alias("n_words"), "contained"]
    return found.select(*key).distinct()


def _places(phrases: dict[str, str]) -> tuple[list[Column], list[Column], list[Column]]:
    """Of each phrase in `spaced` (every word between two spaces of its own): number, first and last start."""
    spaced, counts, firsts, lasts = F.col("spaced"), [], [], []
    gaps = lambda x: ((F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")  # noqa: E731  two for each word
    for phrase in phrases:
        words = phrase.split()
        if any(words[k:] == words[: len(words) - k] for k in range(1, len(words))):
            raise ValueError(f"places of '{phrase}' can overlap")
        said = "".join(f" {w} " for w in words)
        there = spaced.contains(said)
        counts.append(F.when(there, ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(said), F.lit("")))) / len(said.encode())).cast("long")).otherwise(0))
        firsts.append(F.when(there, gaps(F.substring_index(spaced, said, 1))))
        lasts.append(F.when(there, F.col("n_words") - gaps(F.substring_index(spaced, said, -1)) - len(words)))
    return counts, firsts, lasts


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row, whole texts.

    Base places are those of the phrases. labels has the base labels and those of the templates that
    a block meets; score is the largest share of a phrase or template that is there (1 with a base
    place, 0 if nothing was found). Null and empty texts have no words. Rows with equal ids (null
    among them) and texts have equal results and come as often as they are; other columns are
    ignored; an empty table gives no rows. Texts are never shuffled: found blocks join by id and digest.
    """
    blocks = license_blocks(docs, id_col, text_col, templates, threshold)
    found = blocks.groupBy("id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("contained").alias("contained"))
    rows = _rows(docs, id_col, text_col)
    may = F.arrays_overlap("words", _said(sorted({p.split()[-1] for p in phrases})))
    spaced = F.when(may, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise(F.lit(""))
    rows = rows.select("id", "text_hash", F.size("words").cast("long").alias("n_words"), spaced.alias("spaced"))
    counts, firsts, lasts = _places(phrases)
    own = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, label in zip(counts, phrases.values())]))
    least, most = (F.array_min, F.array_max)
    rows = rows.select("id", "text_hash", "n_words", sum(counts, F.lit(0)).cast("long").alias("n_base"), least(F.array(*firsts)).alias("first_word"), most(F.array(*lasts)).alias("last_word"), own.alias("own"))
    both = (F.col("d.text_hash") == F.col("f.text_hash")) & F.col("d.id").eqNullSafe(F.col("f.id"))
    rows = rows.alias("d").join(found.alias("f"), both, "left").select("d.*", "more", "contained")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0)))
    return rows.select("id", "n_words", "n_base", "first_word", "last_word", joined(F.col("own")).alias("base_labels"), joined(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), score.alias("score"))
