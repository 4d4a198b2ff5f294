"""Licence texts found by an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import let, text_of, with_row

# Everything in ASCII but digits and lower-case letters stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINES = "\n"
PARAGRAPHS = r"\n[\x20\x09-\x0D]*\n"

# Phrases whose places are licence marks, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    """A licence text. ``within`` says what one block is: a line or a paragraph."""

    label: str
    within: str
    text: str


# Notices of one line, and passages of licences and their usual notices.
TEMPLATES = [
    Template("mit", LINES, "released under the MIT license"),
    Template("mit", LINES, "licensed under the MIT license"),
    Template("apache", LINES, "licensed under the Apache License, Version 2.0"),
    Template("bsd", LINES, "released under the BSD license"),
    Template("bsd", LINES, "use of this source code is governed by a BSD-style license"),
    Template("gpl", LINES, "this work is licensed under the GNU General Public License, version 3"),
    Template("gpl", LINES, "licensed under the GNU General Public License"),
    Template("lgpl", LINES, "licensed under the GNU Lesser General Public License"),
    Template("mpl", LINES, "this source code form is subject to the terms of the Mozilla Public License"),
    Template("cc-by", LINES, "this work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", LINES, "licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", LINES, "licensed under CC BY-SA 4.0"),
    Template("cc0", LINES, "to the extent possible under law the author has waived all copyright and related rights to this work"),
    Template(
        "mit",
        PARAGRAPHS,
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template(
        "isc",
        PARAGRAPHS,
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "bsd",
        PARAGRAPHS,
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    Template(
        "apache",
        PARAGRAPHS,
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied",
    ),
    Template(
        "gpl",
        PARAGRAPHS,
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version of the license or at your option any later version",
    ),
]

CONTAINED_PERCENT = 90


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def licence_words(text: Column) -> Column:
    """Words of a text that is in lower case already."""
    return F.array_remove(F.split(text, BETWEEN), "")


def _own_words(template: Template) -> list[str]:
    text = template.text.lower()
    return sorted(set("".join(c if c in SMALL + "0123456789" else " " for c in text).split()))


def needed(size: int, percent: int) -> int:
    """How many of ``size`` words are at least this part of them."""
    return -(-size * percent // 100)


def _found_in(block_words: Column, vocabulary: Sequence[str]) -> Column:
    """The words of the vocabulary that a block has, in the order of the vocabulary."""
    return F.array_intersect(F.lit(list(vocabulary)), block_words)


def _blocks(within: str) -> Column:
    return F.split("text", within)


def word_frequencies(docs: DataFrame, templates: Sequence[Template], within: str) -> dict[str, int]:
    """In how many blocks of all texts each word of the templates stands. ``docs``: text, in lower case.

    One pass, combined before the shuffle; one row for each word of the templates comes back.
    """
    vocabulary = sorted({w for t in templates if t.within == within for w in _own_words(t)})
    if not vocabulary:
        return {}
    found = F.transform(_blocks(within), lambda b: _found_in(licence_words(b), vocabulary))
    words = docs.select(F.explode(F.flatten(found)).alias("word"))
    counts = dict(words.groupBy("word").agg(F.count(F.lit(1))).collect())
    return {w: counts.get(w, 0) for w in vocabulary}


def _matches(within: str, templates: Sequence[Template], frequency: Mapping[str, int], percent: int) -> Column:
    """Blocks that contain enough of a template's words: block, label, part contained.

    Words are ordered from the rarest of all blocks on. If a block has ``need`` words of a template, then among the
    first ``size - need + 1`` words of either side there is a common one (prefix filter), and the first common word has
    ``need - 1`` words after it on both sides (position filter). The block's words are those that any template
    has, as no other can be common; it needs that many at least (length filter). What passes is counted.
    """
    order = sorted(frequency, key=lambda w: (frequency[w], w))
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for t in templates:
        words = sorted(_own_words(t), key=place.__getitem__)
        need = needed(len(words), percent)
        rows.append(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(words).alias("words"),
                F.lit(words[: len(words) - need + 1]).alias("prefix"),
                F.lit(need).alias("need"),
            )
        )
    index = F.array(*rows)
    least = min(needed(len(_own_words(t)), percent) for t in templates)

    def possible(words: Column, template: Column) -> Column:
        spare = F.size(words) - template["need"]

        def room(first: Column) -> Column:
            left = F.size(words) - F.array_position(words, first)
            right = F.size(template["words"]) - F.array_position(template["words"], first)
            return F.least(left, right) + 1 >= template["need"]

        common = F.array_intersect(F.slice(words, 1, F.greatest(spare + 1, F.lit(0))), template["prefix"])
        return (spare >= 0) & let(common, lambda c: (F.size(c) > 0) & F.coalesce(room(F.get(c, 0)), F.lit(False)))

    def counted(block: Column, number: Column) -> Column:
        words = _found_in(licence_words(block), order)

        def of_template(words: Column, template: Column) -> Column:
            common = F.size(F.array_intersect(template["words"], words))
            return F.struct(
                number.alias("block"),
                template["label"].alias("label"),
                (common / F.size(template["words"])).alias("part"),
                (common >= template["need"]).alias("enough"),
            )

        def verified(words: Column) -> Column:
            candidates = F.filter(index, lambda t: possible(words, t))
            return F.filter(F.transform(candidates, lambda t: of_template(words, t)), lambda x: x["enough"])

        none = F.array().cast("array<struct<block:int,label:string,part:double,enough:boolean>>")
        return let(words, lambda w: F.when(F.size(w) >= least, verified(w)).otherwise(none))

    found = F.flatten(F.transform(_blocks(within), counted))
    kind = "line" if within == LINES else "paragraph"
    return F.transform(
        found,
        lambda x: F.struct(F.lit(kind).alias("kind"), x["block"].alias("block"), x["label"].alias("label"), x["part"].alias("part")),
    )


def _places(phrases: Mapping[str, str]) -> Column:
    """Where a phrase's words stand consecutively, by start: start, label."""
    none = F.array().cast("array<struct<start:int,label:string>>")

    def starts(phrase: str) -> Column:
        parts = phrase.split()

        def here(i: Column) -> Column:
            same = [F.coalesce(F.get("words", i + k) == part, F.lit(False)) for k, part in enumerate(parts)]
            both = same[0]
            for other in same[1:]:
                both = both & other
            return both

        every = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        placed = F.transform(every, lambda i: F.struct(i.alias("start"), F.lit(phrases[phrase]).alias("label")))
        # A text without the phrase's longest part has no such place.
        return F.when(F.col("text").contains(max(parts, key=len)) & (F.size("words") > 0), placed).otherwise(none)

    return F.array_sort(F.concat(none, *[starts(phrase) for phrase in phrases]))


def scan_licences(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    percent: int = CONTAINED_PERCENT,
    text: str = "text",
) -> DataFrame:
    """Licence marks of every text: row, n_words, places, blocks.

    A-Z are read in lower case; words are runs of digits, a-z and characters beyond ASCII, counted from 0. ``places``
    lists start and label of every place where the words of a phrase stand consecutively. ``blocks`` lists
    every line or paragraph (lines up to one without visible characters) that contains at least ``percent`` % of
    a template's distinct words: its kind, its number from 0 among those of the text, the label, the part contained.

    One row for each row of ``docs``, in the struct ``row``, so repeated rows, NULLs in other columns and clashing names
    pass through. A NULL or empty text has no words, places or blocks. The frequencies that order the words
    change the work, not the result. Two scans, no shuffle but that of the template words' counts; every block is
    matched inside its row, so no key or group gathers in a task.
    """
    rows = with_row(docs, text=lower_ascii(text_of(f"`{text}`")))
    matches = []
    for within in (LINES, PARAGRAPHS):
        some = [t for t in templates if t.within == within]
        if some:
            matches.append(_matches(within, some, word_frequencies(rows.select("text"), some, within), percent))
    none = F.array().cast("array<struct<kind:string,block:int,label:string,part:double>>")
    rows = rows.withColumn("words", licence_words(F.col("text")))
    return rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        _places(phrases).alias("places"),
        F.concat(none, *matches).alias("blocks"),
    )
