"""Licence scans with a positional index of rare tokens, in DataFrame functions only.

Every licence phrase or text is a template.  One pass counts in how many documents each
template word occurs; the rarest words of a template (the highest IDF) are its postings, a
word and its place.  A second pass looks up each file's postings words: such a word at place i
of the file that is at place p of a template proposes that the template starts at i - p.  The
other postings are intersected by relative position - the file must have them at start + place
- and where enough agree, the mandatory key phrases are compared word for word.

A file is handled inside its own row, in time that grows with its words, so nothing is
shuffled but the counts, which are one row a template word.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What stands between words.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Postings a template has at most, and the share of them that must agree.
POSTINGS, AGREE = 6, 0.6
#: Places of words have so many bits; an array has fewer than 2^31 entries.
PLACE_BITS = 32

#: Phrases whose every place counts: (label, words).
BASE: tuple[tuple[str, str], ...] = (
    ("apache", "apache license"),
    ("gpl", "general public license"),
    ("mit", "mit license"),
)

#: The method's own templates: (label, text, key phrases that must be there word for word).
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("agpl-text", "gnu affero general public license", ("affero general public license",)),
    ("apache-notice", "licensed under the apache license version", ("apache license version",)),
    (
        "apache-text",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license", "obtain a copy of the license"),
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    ("cc-by", "licensed under cc by", ("cc by",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc-text", "licensed under a creative commons attribution", ("creative commons attribution",)),
    ("gpl-notice", "licensed under the gnu general public license version", ("gnu general public license",)),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("under the terms of the gnu general public license", "free software foundation"),
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    ("lgpl-text", "gnu lesser general public license", ("lesser general public license",)),
    ("mit-notice", "released under the mit license", ("mit license",)),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("hereby granted free of charge", "associated documentation files"),
    ),
    ("mpl-text", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("unlicense-text", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words_of(text: Column) -> Column:
    """The words of a whole text, A to Z in lower case and no other letter changed; null has none.

    ``lower`` would turn two letters beyond ASCII into ASCII ones, the Kelvin sign and the dotted
    capital I; they are exchanged for another letter first.
    """
    plain = F.coalesce(text.cast("string"), F.lit(""))
    for letter in ("K", "İ"):
        plain = F.replace(plain, F.lit(letter), F.lit("é"))
    return F.array_remove(F.split(F.lower(plain), GAP, -1), "")


def _at(phrase: list[str], words: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _templates(base, templates) -> list[dict]:
    out = [{"label": label, "base": True, "words": text.split(), "phrases": [(0, text.split())]} for label, text in base]
    for label, text, phrases in templates:
        words = text.split()
        out.append({"label": label, "base": False, "words": words, "phrases": [(_at(p.split(), words), p.split()) for p in phrases]})
    return out


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and for each template word those that have it: one row a word comes to the driver."""
    mine = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counted = words.select(F.explode(F.array_append(mine, F.lit("")))).groupBy("col").count().collect()
    found = {r["col"]: r["count"] for r in counted}
    return found.pop("", 0), found


def indexed(templates: list[dict], n: int, df: dict[str, int]) -> list[dict]:
    """Give each template its postings: all words of a base phrase, else the ``POSTINGS`` rarest."""
    out = []
    for t in templates:
        places = {}
        for p, w in enumerate(t["words"]):
            places.setdefault(w, p)
        idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in places}
        rare = sorted(places, key=lambda w: (-idf[w], w))
        rare = list(places) if t["base"] else rare[:POSTINGS]
        need = len(rare) if t["base"] else math.ceil(AGREE * len(rare))
        out.append(t | {"postings": [(w, places[w]) for w in rare], "need": need})
    return out


def _literal(templates: list[dict]) -> Column:
    """The templates as one constant array of structs."""
    plain = [
        {
            "label": t["label"],
            "base": t["base"],
            "need": t["need"],
            "postings": [{"w": w, "p": p} for w, p in t["postings"]],
            "phrases": [{"o": o, "w": w} for o, w in t["phrases"]],
        }
        for t in templates
    ]
    kind = (
        "array<struct<label:string,base:boolean,need:int,postings:array<struct<w:string,p:int>>,"
        "phrases:array<struct<o:int,w:array<string>>>>>"
    )
    return F.from_json(F.lit(json.dumps(plain)), kind)


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest of their starts (null without any).  ``labels`` has the base labels
    and those of the templates found; ``score`` is the largest share of a found template's
    postings that agreed, 0 without any.  Null texts have no words.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    plain = _templates(base, templates)
    vocabulary = sorted({w for t in plain for w in t["words"]})
    known = indexed(plain, *document_frequencies(rows, vocabulary))
    lookup: dict[str, list[dict[str, int]]] = {}
    for k, t in enumerate(known):
        for w, p in t["postings"]:
            lookup.setdefault(w, []).append({"t": k, "p": p})
    by_word = F.from_json(F.lit(json.dumps(lookup)), "map<string,array<struct<t:int,p:int>>>")
    every = _literal(known)

    def votes(t: Column, start: Column) -> Column:
        agree = F.filter(F.get(every, t)["postings"], lambda q: F.get(F.col("words"), start + q["p"]) == q["w"])
        return F.size(agree)

    def verified(x: Column) -> Column:
        return (x["v"] >= F.get(every, x["t"])["need"]) & F.forall(
            F.get(every, x["t"])["phrases"], lambda q: F.slice(F.col("words"), x["s"] + q["o"] + 1, F.size(q["w"])) == q["w"]
        )

    hits = F.array_compact(
        F.transform("words", lambda w, i: F.when(w.isin(sorted(lookup)), F.struct(i.alias("i"), w.alias("w"))))
    )
    # A template and where it would start are one number: Spark finds equal numbers by hash, equal structs by comparing all pairs.
    def proposed(h: Column) -> Column:
        fits = F.filter(by_word[h["w"]], lambda q: h["i"] >= q["p"])
        return F.transform(fits, lambda q: F.shiftleft(q["t"].cast("long"), PLACE_BITS) + (h["i"] - q["p"]))

    starts = F.array_distinct(F.flatten(F.transform("hits", proposed)))

    def scored(x: Column) -> Column:
        t, s = F.shiftright(x, PLACE_BITS).cast("int"), x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        return F.struct(t.alias("t"), s.alias("s"), votes(t, s).alias("v"))

    def labels_of(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.get(every, x["t"])["label"]))), ",")

    found = (
        rows.withColumn("hits", hits)
        .withColumn("starts", starts)
        .withColumn("found", F.filter(F.transform("starts", scored), verified))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), "found")
        .withColumn("places", F.transform(F.filter("found", lambda x: F.get(every, x["t"])["base"]), lambda x: x["s"]))
        .withColumn("base_found", F.filter("found", lambda x: F.get(every, x["t"])["base"]))
    )
    share = F.transform("found", lambda x: x["v"] / F.size(F.get(every, x["t"])["postings"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        labels_of(F.col("base_found")).alias("base_labels"),
        labels_of(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
    )
