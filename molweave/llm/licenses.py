"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a line, or a window of WINDOW words every STRIDE words of a longer line, or such a window of the whole text across
its line ends, since notices are often wrapped. A block meets a template if it holds at least THRESHOLD of the template's
distinct words. Windows of the whole text are made where the text holds that much of a template, while its words are read. The
join goes by prefix filtering:

1. Order. The words of all templates are counted over the whole corpus and ordered from rare to frequent.
2. Prefix filter. A block that meets a template of m words, c of them needed, holds one of its m - c + 1 rarest. Only lines in
   which such a word occurs are split into words, and a block is joined with the templates that have the word in their prefix.
3. Length and positional filters. A block with fewer than c template words is dropped, and so is a pair whose words after the
   shared one, on either side, can't bring the overlap to c.
4. What is left is verified by the full overlap.

Besides, the phrases of BASE are found wherever their words stand one after the other.

The templates are a constant of the library, so their index is broadcast; counts of template words are the only thing that goes
to the driver. Null text is an empty one: no words, no labels, score 0. Rows that repeat an id are rows of their own. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.sources.scratch import stored

# Letters, digits and characters beyond ASCII of a lower-cased text, named and not excluded: Java matches it 12 times as fast.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW, STRIDE = 64, 32
THRESHOLD = 0.9

# Phrases that always count, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words or notices of public licenses. A template is shorter than STRIDE words.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def folded(text: Column) -> Column:
    """Lower case. Two letters beyond ASCII whose lower case is in ASCII are exchanged for others first, so what compares equal
    to a word in ASCII is what would with A-Z alone lower-cased."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.lower(kept)


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def needed(words: int, threshold: float) -> int:
    return math.ceil(threshold * words - 1e-9)


def vocabulary_of(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def windows_of(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - STRIDE - 1), F.lit(STRIDE))
    return F.transform(starts, lambda s: F.slice(words, s + 1, WINDOW))


def document_rows(documents: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, n_words, held, wide, at_0, ...): number of words, template words held by the text and by each of its windows,
    starts of each base phrase. Texts that meet no template as a whole have no windows.

    The key tells texts apart where rows repeat an id. One reading of the texts makes all of it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("key"), words_of(folded(text)).alias("words"))
    starts = [phrase_places(F.col("words"), phrase).alias(f"at_{i}") for i, phrase in enumerate(BASE)]
    vocabulary = literal_array(vocabulary_of(templates))
    read = words.withColumn("held", F.array_intersect(vocabulary, "words"))
    meets, least = F.lit(False), len(vocabulary_of(templates))
    for tokens in {tuple(sorted(set(t.split()))) for _, t in templates}:
        c = needed(len(tokens), threshold)
        meets, least = meets | (F.size(F.array_intersect(literal_array(list(tokens)), "held")) >= c), min(least, c)
    held = F.transform(windows_of(F.col("words")), lambda w: F.array_intersect(vocabulary, w))
    wide = F.when(meets, F.filter(held, lambda h: F.size(h) >= least)).otherwise(F.array().cast("array<array<string>>")).alias("wide")
    return read.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "held", wide, *starts)


def rare_first(rows: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words by the number of documents that hold them, rarest first. As many rows as template words."""
    counts = {r["word"]: r["count"] for r in rows.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary_of(templates), key=lambda w: (counts.get(w, 0), w))


def template_index(spark, templates: list[tuple[str, str]], order: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(template, label, tokens, m, c) and the prefix index (token, template, place)."""
    place = {w: i for i, w in enumerate(order)}
    rows, index = [], []
    for i, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=place.get)
        c = needed(len(tokens), threshold)
        rows.append((i, label, tokens, len(tokens), c))
        index += [(w, i, k) for k, w in enumerate(tokens[: len(tokens) - c + 1])]
    return (
        spark.createDataFrame(rows, "template int, label string, tokens array<string>, m int, c int"),
        spark.createDataFrame(index, "token string, template int, place int"),
    )


def meeting_blocks(
    documents: DataFrame, rows: DataFrame, templates: list[tuple[str, str]], order: list[str], threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, key, label, containment): every block that meets a template. ``rows`` are those of ``document_rows``."""
    spark = documents.sparkSession
    described, index = template_index(spark, templates, order, threshold)
    sizes = [len(set(t.split())) for _, t in templates]
    least = min(needed(m, threshold) for m in sizes)
    place = {w: i for i, w in enumerate(order)}
    prefix = {
        w for _, t in templates for w in sorted(set(t.split()), key=place.get)[: len(set(t.split())) - needed(len(set(t.split())), threshold) + 1]
    }
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("key"), F.explode(F.split(folded(text), r"[\n\r]+")).alias("line")
    )
    some = F.lit(False)
    for word in sorted(prefix):
        some = some | F.contains("line", F.lit(word))
    words = lines.filter(some).select("doc_id", "key", words_of(F.col("line")).alias("words"))
    blocks = words.select("doc_id", "key", F.explode(windows_of(F.col("words"))).alias("block"))
    blocks = blocks.union(rows.select("doc_id", "key", F.explode("wide").alias("block")))
    held = blocks.select("doc_id", "key", F.array_intersect(literal_array(order), "block").alias("held")).filter(F.size("held") >= least)
    probes = held.select("*", F.posexplode("held").alias("at", "token"))
    pairs = (
        probes.join(F.broadcast(index), "token")
        .join(F.broadcast(described), "template")
        .filter(F.size("held") >= F.col("c"))
        .filter(1 + F.least(F.col("m") - F.col("place") - 1, F.size("held") - F.col("at") - 1) + F.least("place", "at") >= F.col("c"))
    )
    overlap = F.size(F.array_intersect("tokens", "held"))
    return pairs.filter(overlap >= F.col("c")).select("doc_id", "key", "label", (overlap / F.col("m")).alias("containment"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Start of every place where the phrase's words stand one after the other."""
    parts = phrase.split()

    def stands(at: Column) -> Column:
        same = F.get(words, at) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, at + k) == part)
        return same

    positions = F.sequence(F.lit(0), F.size(words) - 1)
    return F.when(F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]), F.filter(positions, stands)).otherwise(
        F.array().cast("array<int>")
    )


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    rows = stored(document_rows(documents, templates, threshold), "licenses")
    order = rare_first(rows, templates)
    found = (
        meeting_blocks(documents, rows, templates, order, threshold)
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    )
    all_starts = F.concat(*[F.col(f"at_{i}") for i in range(len(BASE))])
    labels = [F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())]
    based = rows.select(
        "doc_id",
        "key",
        "n_words",
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    )
    same = based["doc_id"].eqNullSafe(found["_id"]) & (based["key"] == found["_key"])
    met = F.coalesce("met", F.array().cast("array<string>"))
    return based.join(found, same, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", met)), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )
