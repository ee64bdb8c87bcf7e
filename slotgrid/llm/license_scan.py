"""License scan: phrases, and an exact set-similarity join of text blocks with license templates. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: A table of texts to look at of at most so many rows (some 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notice texts of public licenses.
TEMPLATES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-short": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "rights-reserved": "All rights reserved",
}


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; a text of ASCII alone takes the cheaper way."""
    letters = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(letters)


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(WORD, text.lower())))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _phrase(phrase: str) -> str:
    inner = WORD.removeprefix("[^").removesuffix("]+")
    gap = f"[{inner}]+"
    return rf"(?<![^{inner}])" + gap.join(phrase.split()) + rf"(?![^{inner}])"


def places(w: Column, present: Column, phrase: str) -> Column:
    """Places, from 0, in the words `w` where those of `phrase` stand consecutively; only texts that hold each of them are searched."""
    parts = phrase.split()
    last = F.size(w) - len(parts)

    def here(i: Column) -> Column:
        out = w[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (w[i + k] == part)
        return out

    all_there = F.size(F.array_intersect(present, F.array(*[F.lit(p) for p in dict.fromkeys(parts)]))) == len(set(parts))
    return F.when(all_there & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def read_words(docs: DataFrame, keys: list[str], text: str, tokens: list[str]) -> DataFrame:
    """(keys, n_words, present, a column per phrase label): each text is cut into words once; `present` are those of `tokens` that it holds."""
    known = F.array(*[F.lit(t) for t in tokens])

    def of(z: Column) -> Column:
        w, present = z["w"], z["present"]
        return F.struct(F.size(w).cast("long").alias("n_words"), present.alias("present"), *[places(w, present, p).alias(label) for p, label in PHRASES.items()])

    # the lambdas make the words, and the tokens among them, once for all that is read from them
    found = F.transform(F.transform(F.array(words(F.col(text))), lambda w: F.struct(w.alias("w"), F.array_intersect(w, known).alias("present"))), of)[0]
    return docs.select(*keys, found.alias("_f")).select(*keys, "_f.*")


def frequencies(read: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many documents each template token stands; at most one row a token reaches the driver."""
    counted = read.select(F.explode("present").alias("token")).groupBy("token").count().where(F.col("token").isin(tokens)).collect()
    return {t: 0 for t in tokens} | {r["token"]: r["count"] for r in counted}


def window_matches(held: DataFrame, text: str, keys: list[str], ordered: dict[str, list[str]], containment: float) -> DataFrame:
    """(keys, label, containment): the best share of each template's words in a window of the text, line ends or not, where it reaches the limit.

    `held` has texts with `wanted`, the templates of which they hold enough words. A window has the template's number of words over the
    limit, so it has room for marks between wrapped lines; words of one template that stand farther apart are not found. It starts at a word of the template; it
    is dropped if the word that would make it long enough stands beyond its end, or if it holds none of the template's prefix, and only then counted.
    """
    split = held.select(*keys, words(F.col(text)).alias("w"), F.explode("wanted").alias("label"))

    def best(label: str, template: list[str]) -> Column:
        size = math.ceil(len(re.findall(WORD, TEMPLATES[label])) / containment)
        need = math.ceil(containment * len(template) - 1e-9)
        own, prefix = (F.array(*[F.lit(t) for t in ts]) for ts in (template, template[: len(template) - need + 1]))
        placed = F.transform("w", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
        hits = F.filter(placed, lambda x: F.array_contains(own, x["t"]))

        def count(h: Column) -> Column:
            def window(x: Column, at: Column) -> Column:
                inside = F.transform(F.filter(F.slice(h, at + 1, F.lit(size)), lambda y: y["i"] < x["i"] + size), lambda y: y["t"])
                long_enough = F.get(h, at + (need - 1))["i"] < x["i"] + size
                return F.when(long_enough, F.when(F.arrays_overlap(inside, prefix), F.size(F.array_distinct(inside))))

            return F.array_max(F.transform(h, window))

        # the outer lambda makes the hits once, not once a window
        return F.struct(F.transform(F.array(hits), count)[0].alias("share"), F.lit(need).alias("need"), F.lit(len(template)).alias("n"))

    cell = F.lit(None)
    for label, template in ordered.items():
        cell = F.when(F.col("label") == label, best(label, template)).otherwise(cell)
    cells = split.select(*keys, "label", cell.alias("c"))
    return cells.where("c.share >= c.need").select(*keys, "label", (F.col("c.share") / F.col("c.n")).alias("containment"))


def template_matches(docs: DataFrame, read: DataFrame, text: str, keys: list[str], containment: float = CONTAINMENT) -> DataFrame:
    """(keys, label, containment): the best containment of each template in a line or a window of words of a document, where it reaches the limit.

    Tokens are ordered by their frequency over all documents, rarest first. A line that shares k = ceil(t n) of a template's
    n words has one of the template's first n - k + 1, and its own tokens that any template knows are in the same order:
    the shared token that comes first leaves k or more from it on in both. So a line joins by the prefix of each template,
    is dropped if it is too short or the token stands too late on either side, and only then is counted exactly.
    `read` is what `read_words` gives for `docs`: lines and windows of a text are looked at only if the whole of it holds enough words of a template.
    """
    sets = {label: template_words(body) for label, body in TEMPLATES.items()}
    seen = frequencies(read, sorted({w for ws in sets.values() for w in ws}))
    spark = docs.sparkSession
    rows, ordered = [], {}
    for label, ws in sets.items():
        ordered[label] = sorted(ws, key=lambda w: (seen[w], w))
        need = math.ceil(containment * len(ws) - 1e-9)
        rows += [(w, at, label, ordered[label], need) for at, w in enumerate(ordered[label][: len(ws) - need + 1])]
    index = spark.createDataFrame(rows, "token string, at int, label string, template array<string>, need int")
    enough = []
    for label, ws in sets.items():
        need = math.ceil(containment * len(ws) - 1e-9)
        enough.append(F.when(F.size(F.array_intersect("present", F.array(*[F.lit(w) for w in ws]))) >= need, F.lit(label)))
    wanted = read.select(*[F.col(k).alias(f"_{k}") for k in keys], F.array_compact(F.array(*enough)).alias("wanted")).where(F.size("wanted") > 0).distinct()
    wanted = Scratch(spark, "licenses").keep(wanted)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    held = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, same).select(*keys, text, "wanted")
    prefix = sorted({r[0] for r in rows})
    any_prefix = _phrase("|".join(prefix)).replace("|".join(prefix), "(?:" + "|".join(prefix) + ")")
    lines = held.select(*keys, F.explode(F.filter(F.split(lowered(F.col(text)), "\n"), lambda s: F.regexp_like(s, F.lit(any_prefix)))).alias("line"))
    order = sorted(seen, key=lambda w: (seen[w], w))
    bags = lines.select(*keys, F.array_intersect(F.array(*[F.lit(t) for t in order]), F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("bag"))
    tokens = bags.select(*keys, "bag", F.posexplode("bag").alias("place", "token"))
    # the index is made from the fixed templates, a few hundred short rows
    near = tokens.join(F.broadcast(index), "token").where("size(bag) - place >= need AND size(template) - at >= need")
    share = F.size(F.array_intersect("bag", "template"))
    full = near.withColumn("share", share).where("share >= need").withColumn("containment", F.col("share") / F.size("template"))
    full = full.select(*keys, "label", "containment").union(window_matches(held, text, keys, ordered, containment))
    return full.groupBy(*keys, "label").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, containment: float = CONTAINMENT) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of `docs`.

    Base places are those of `PHRASES`; `labels` adds the templates found (see `template_matches`); score is the best
    containment, 1 where a phrase stands, 0 where nothing does. Blocks are lines, and windows of words across line ends. Null texts count as empty: no words, no
    labels, null places, score 0. Rows equal in id and text are found alike; null ids are kept; other columns
    are not read; an empty table gives an empty one.
    """
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    tokens = sorted({w for phrase in PHRASES for w in phrase.split()} | {w for t in TEMPLATES.values() for w in template_words(t)})
    read = Scratch(docs.sparkSession, "license-words").keep(read_words(body, ["id", "text_hash"], "text", tokens))
    labels = template_matches(body, read, "text", ["id", "text_hash"], containment)
    labels = labels.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    every = F.concat(*[F.col(label) for label in PHRASES.values()])
    found = F.filter(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in PHRASES.values()]), lambda x: x.isNotNull())
    based = read.select("id", "text_hash", "n_words", every.alias("every"), found.alias("found"))
    out = based.join(labels, based["id"].eqNullSafe(labels["_id"]) & (based["text_hash"] == labels["_hash"]), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join(F.array_sort("found"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("found", more)), ",").alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
