"""License scans: an exact set-similarity join of text blocks with license templates, and named phrases.

A block is a line, or a run of 2 to ``RUN`` adjacent lines without a blank one among them, as notices are often wrapped.
It meets a template if it holds at least ``CONTAINMENT`` of the template's distinct words; a run must also have at most ``DILUTION``
times as many distinct words as the template, so that long paragraphs do not gather its words by chance.
Template words are ordered from rare to frequent by the number of documents that have them, counted over all documents; a block that meets
a template of n words with need k = ceil(CONTAINMENT * n) must hold one of its first n - k + 1 words (prefix), have at
least k words itself (length), and, where its first common word is the template's p-th, still have n - p >= k - 1
words to come (position). Blocks that pass are compared in full, so the join is exact. The index from prefix words to templates is a
constant of the plan, so any table of a few hundred templates can be given; each row is joined where it is read, and no text is shuffled.

Phrases are found anywhere, also across lines. Null and empty texts hold nothing; repeated rows are scanned one by one.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns

CONTAINMENT, RUN, DILUTION = 0.8, 4, 2
#: Phrases and the labels of places where their words stand one after another.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wordings of public license notices, in lower case without punctuation, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def phrase_pattern(phrase: str) -> str:
    """The phrase's words one after another, in any case of A-Z."""
    return f"(?i)(?<!{_WORD})" + f"{_GAP}+".join(phrase.split()) + f"(?!{_WORD})"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD + "+"))


def block_words(block: Column) -> Column:
    """The distinct words of a block, in lower case."""
    return F.array_distinct(F.split(ascii_lower(block), _GAP + "+"))


def need(n: int, containment: float = CONTAINMENT) -> int:
    return ceil(containment * n - 1e-9)


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """How many documents hold each template word: one pass over all texts, a row for each template word."""
    known = sorted({w for _, t in templates for w in t.split()})
    held = F.array_intersect(F.split(ascii_lower(F.coalesce("text", F.lit(""))), _GAP + "+"), F.array(*[F.lit(w) for w in known]))
    got = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in known} | {r["w"]: r["count"] for r in got}


def prefixes(frequency: dict[str, int], templates=TEMPLATES, containment: float = CONTAINMENT) -> list[tuple[str, list[str], int, list[str]]]:
    """(label, words from rare to frequent, needed overlap, prefix) of each template."""
    found = []
    for label, text in templates:
        ordered = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        k = need(len(ordered), containment)
        found.append((label, ordered, k, ordered[: len(ordered) - k + 1]))
    return found


def _constant(value, kind: str) -> Column:
    """A nested value, folded to a constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """The row as ``_row`` and ``_text``, with ``_found``: an array of (block, lines, label, containment), one for each block and template that meet."""
    index = prefixes(frequencies(docs, templates), templates, containment)
    rare = sorted({w for _, _, _, prefix in index for w in prefix})
    any_rare = f"(?i)(?<!{_WORD})(?:{'|'.join(rare)})(?!{_WORD})"
    of_word = _constant({w: [i for i, entry in enumerate(index) if w in entry[3]] for w in rare}, "map<string,array<int>>")
    entries = _constant([{"label": label, "words": ordered, "need": k} for label, ordered, k, _ in index], "array<struct<label:string,words:array<string>,need:int>>")
    step = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    step = step.withColumn("_lines", F.when(F.col("_text").rlike(any_rare), F.split("_text", "\n")))
    marked = F.transform("_lines", lambda b: F.struct(b.alias("text"), b.rlike(_WORD).alias("full"), b.rlike(any_rare).alias("rare")))
    step = step.withColumn("_marked", marked)

    def runs(lines: int) -> Column:
        """Runs of so many lines that may meet a template: all have a word, and one has a prefix word."""
        at = F.sequence(F.lit(0), F.size("_marked") - lines)
        part = lambda i: F.slice("_marked", i + 1, lines)
        whole = lambda i: F.exists(part(i), lambda b: b["rare"]) & F.forall(part(i), lambda b: b["full"])
        words = lambda i: block_words(F.array_join(F.transform(part(i), lambda b: b["text"]), "\n"))
        found = F.transform(F.filter(at, whole), lambda i: F.struct(i.alias("block"), F.lit(lines).alias("lines"), words(i).alias("words")))
        return F.when(F.size("_marked") >= lines, found).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("lines"), F.array().cast("array<string>").alias("words"))), 1, 0))

    step = step.withColumn("_blocks", F.when(F.col("_marked").isNotNull(), F.concat(*[runs(n) for n in range(1, RUN + 1)])))
    # blocks and the templates that they share a prefix word with
    candidates = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.transform(
                F.array_distinct(F.flatten(F.transform(b["words"], lambda w: F.coalesce(F.element_at(of_word, w), F.array().cast("array<int>"))))),
                lambda t: F.struct(b["block"].alias("block"), b["lines"].alias("lines"), b["words"].alias("words"), F.get(entries, t).alias("t")),
            ),
        )
    )
    step = step.withColumn("_candidates", candidates)

    def compared(c: Column) -> Column:
        # the template's words are in order, so the first common one comes first in the intersection
        common = F.array_intersect(c["t"]["words"], c["words"])
        position = F.array_position(c["t"]["words"], F.get(common, F.lit(0)))
        return F.struct(c["block"].alias("block"), c["lines"].alias("lines"), c["t"]["label"].alias("label"), c["t"]["need"].alias("need"), F.size(c["t"]["words"]).alias("n"), position.alias("position"), F.size(common).alias("common"))

    long_enough = F.filter("_candidates", lambda c: (F.size(c["words"]) >= c["t"]["need"]) & ((c["lines"] == 1) | (F.size(c["words"]) <= DILUTION * F.size(c["t"]["words"]))))
    step = step.withColumn("_compared", F.transform(long_enough, compared))
    met = F.filter("_compared", lambda c: (c["n"] - c["position"] >= c["need"] - 1) & (c["common"] >= c["need"]))
    found = F.transform(met, lambda c: F.struct(c["block"].alias("block"), c["lines"].alias("lines"), c["label"].alias("label"), (c["common"] / c["n"]).alias("containment")))
    return step.withColumn("_found", found).select("_row", "_text", "_found")


def block_matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """The join's pairs: doc_id, block (number of its first line from 0), lines, label, containment."""
    hit = matches(columns(docs, "doc_id", "text"), templates, containment).select(F.col("_row.doc_id").alias("doc_id"), F.explode("_found").alias("m"))
    return hit.select("doc_id", "m.block", "m.lines", "m.label", "m.containment")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    step = matches(columns(docs, "doc_id", "text"))
    text = F.col("_text")
    places = {}
    for i, phrase in enumerate(PHRASES):
        step = step.withColumn(f"_n{i}", F.regexp_count(text, F.lit(phrase_pattern(phrase))))
        places[phrase] = i
    hits = [F.col(f"_n{i}") for i in places.values()]
    first, last = [], []
    for phrase, i in places.items():
        pattern = phrase_pattern(phrase)
        before = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(pattern)) - 1)
        first.append(F.when(F.col(f"_n{i}") > 0, n_words(before)))
        last.append(F.when(F.col(f"_n{i}") > 0, n_words(F.regexp_extract(text, "(?s)^(.*)" + pattern, 1))))
    total = sum(hits[1:], hits[0])
    base = F.array_sort(F.array_compact(F.array(*[F.when(h > 0, F.lit(PHRASES[p])) for p, h in zip(places, hits, strict=True)])))
    step = step.withColumn("_base", base)
    own = F.coalesce(F.transform("_found", lambda m: m["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("_found", lambda m: m["containment"])), F.lit(0.0))
    return step.select(
        F.col("_row.doc_id").alias("doc_id"),
        n_words(text).cast("long").alias("n_words"),
        total.cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", own)), ",").alias("labels"),
        F.greatest(best, F.when(total > 0, 1.0).otherwise(0.0)).alias("score"),
    )
