"""Licence scan by a positional index of rare licence words, in DataFrame operations only.

A template counts only where all its mandatory key phrases stand in place, so every place that counts holds each word of
them. Of these words the two of highest inverse document frequency in the corpus are looked up in a file: their positions,
moved by where they stand in the template, are postings of the same template offset, and their intersection are the
candidates. The key phrases and the share of the whole template are verified there alone. No place that counts is missed.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening words of public licence notices (lower case, words only), the label, and the phrases that must stand in place.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("epl", "the terms of the eclipse public license", ["eclipse public license"]),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license as published by", "version 3 of the license"]),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license as published by", "version 2 of the license"]),
    ("gpl-3.0", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("apache-2.0", "http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ["provided as is without warranty of any kind express or implied", "warranties of merchantability"]),
]
#: Identifiers of the public list of licence tags, and their labels.
TAGS = {
    "MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-3.0": "gpl-3.0", "GPL-2.0": "gpl-2.0", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "MPL-2.0": "mpl-2.0", "ISC": "isc", "Unlicense": "unlicense", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-SA-4.0": "cc-by-sa", "CC0-1.0": "cc0", "EPL-2.0": "epl",
}
for _tag, _label in TAGS.items():
    _words = "spdx license identifier " + _tag.lower().replace("-", " ").replace(".", " ")
    TEMPLATES.append((_label, _words, [_words]))

#: Least share of a template's words that must stand in place besides its key phrases.
LEAST_SHARE = 0.6


#: Names that ``scan`` adds.
OUTPUTS = ("ls_n_words", "ls_n_base", "ls_first_word", "ls_last_word", "ls_base_labels", "ls_labels", "ls_score")


def key_words() -> list[list[tuple[str, int]]]:
    """Of each template the distinct words of its key phrases with the first place of each inside one."""
    out = []
    for _, body, phrases in TEMPLATES:
        b, found = body.split(), {}
        for phrase in (p.split() for p in phrases):
            at = next(i for i in range(len(b)) if b[i : i + len(phrase)] == phrase)
            for k, w in enumerate(phrase):
                found.setdefault(w, at + k)
        out.append(sorted(found.items()))
    return out


def vocabulary() -> list[str]:
    return sorted({w for words_ in key_words() for w, _ in words_})


def anchors(counts: dict[str, int]) -> list[tuple[tuple[str, int], tuple[str, int]] | None]:
    """Of each template its two key words of highest IDF (fewest documents, then alphabetically) with their places.

    None where one of its key words is in no document; a template of one key word has it twice.
    """
    out: list[tuple[tuple[str, int], tuple[str, int]] | None] = []
    for found in key_words():
        ranked = sorted(found, key=lambda x: (counts.get(x[0], 0), x[0]))
        out.append((ranked[0], ranked[min(1, len(ranked) - 1)]) if counts.get(ranked[0][0], 0) else None)
    return out


def words(text: Column) -> Column:
    """Words of the whole text after lower-casing A-Z, as an array."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(w: Column, phrase: list[str]) -> Column:
    """Word positions, from 0, where the phrase's words stand consecutively; the rarest test comes first."""
    gate = F.lit(True)
    for x in reversed(phrase):
        gate = gate & F.array_contains(w, x)
    hit = lambda i: reduce(and_, [F.get(w, i + k) == x for k, x in enumerate(phrase)])
    return F.when(gate & (F.size(w) >= len(phrase)), F.filter(F.sequence(F.lit(0), F.size(w) - len(phrase)), hit)).otherwise(F.array().cast("array<int>"))


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents that hold each licence word, over all rows; at most one row for each vocabulary word reaches the driver."""
    found = docs.select(F.explode(F.array_intersect(F.col("ls_words"), _strings(vocabulary()))).alias("w"))
    return {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ls_n_words, ls_n_base, ls_first_word, ls_last_word, ls_base_labels, ls_labels, ls_score.

    Base: all places of the phrases of BASE. The method: the two rarest words of a template's key phrases are looked up in
    each file, in one filter of its words for all templates; offsets that both agree on are candidates, and count if every
    key phrase stands in place and LEAST_SHARE of the template's words do. Score: 1 with a base place, else the best share
    of a template that counts, else 0.
    A null or empty text has no words; labels are then empty and the places null. Texts of any length are read whole;
    repeated rows give a row each, an empty table none. All columns of ``docs`` stay, but one named as an output gives way
    to it. No shuffle but for the word counts, for which the texts are read once when this is called.
    """
    rows = docs.select(common.row_of(docs, OUTPUTS).alias("ls_row"), words(F.coalesce(F.col(text), F.lit(""))).alias("ls_words"))
    counts = document_frequencies(rows)
    looked_up = anchors(counts)
    alive = [t for t, a in enumerate(looked_up) if a]
    for label, phrase in [(label, p.split()) for p, label in BASE.items()]:
        rows = rows.withColumn(f"ls_at_{label}", _places(F.col("ls_words"), phrase))
    at = {label: F.col(f"ls_at_{label}") for label in BASE.values()}
    rows = rows.withColumn("ls_starts", F.concat(*at.values()))
    rows = rows.withColumn("ls_base", F.concat(*[F.when(F.size(c) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for label, c in at.items()]))
    none = F.array().cast("array<struct<label:string,share:double>>")
    if alive:
        w = F.col("ls_words")
        rare = sorted({x for t in alive for x, _ in looked_up[t]}, key=lambda x: (counts[x], x))
        # array_intersect keeps the order of its first side: the anchors by descending IDF
        rows = rows.withColumn("ls_rare", F.array_intersect(_strings(rare), w))
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: F.array_contains(F.col("ls_rare"), x["w"]))
        rows = rows.withColumn("ls_hits", F.when(F.size("ls_rare") > 0, hits))

        def candidates_of(t: int) -> Column:
            offsets = lambda x, p: F.transform(F.filter(F.col("ls_hits"), lambda h: h["w"] == x), lambda h: h["i"] - p)
            (x, p), (y, q) = looked_up[t]
            both = F.array_intersect(offsets(x, p), offsets(y, q)) if x != y else F.array_distinct(offsets(x, p))
            there = F.array_contains("ls_rare", x) & F.array_contains("ls_rare", y)
            return F.when(there, F.transform(both, lambda o: F.struct(F.lit(t).alias("t"), o.alias("o")))).otherwise(F.array().cast("array<struct<t:int,o:int>>"))

        rows = rows.withColumn("ls_candidates", F.when(F.size("ls_hits") > 0, F.flatten(F.array(*[candidates_of(t) for t in alive]))))
        bodies = F.array(*[_strings(body.split()) for _, body, _ in TEMPLATES])

        def key_phrases(v: Column) -> Column:
            ok = F.lit(False)
            for t, (_, body, phrases) in ((t, TEMPLATES[t]) for t in alive):
                here = v["t"] == t
                for phrase in phrases:
                    p = body.split()
                    k = next(i for i in range(len(p)) if p[i : i + len(phrase.split())] == phrase.split())
                    begin = v["o"] + k
                    here = here & (begin >= 0) & (F.slice(w, F.greatest(begin, F.lit(0)) + 1, len(phrase.split())) == _strings(phrase.split()))
                ok = ok | here
            return ok

        def share(v: Column) -> Column:
            body = F.element_at(bodies, v["t"] + 1)
            placed = F.filter(F.transform(body, lambda x, i: F.coalesce(F.get(w, v["o"] + i) == x, F.lit(False))), lambda b: b)
            return F.size(placed) / F.size(body)

        names = _strings([label for label, _, _ in TEMPLATES])
        counted = F.filter(F.transform(F.filter(F.col("ls_candidates"), key_phrases), lambda v: F.struct(F.element_at(names, v["t"] + 1).alias("label"), share(v).alias("share"))), lambda x: x["share"] >= LEAST_SHARE)
        rows = rows.withColumn("ls_found", F.when(F.size("ls_candidates") > 0, counted).otherwise(none))
    else:
        rows = rows.withColumn("ls_found", none)
    n_base = F.size("ls_starts")
    return rows.select(
        "ls_row.*",
        F.size("ls_words").cast("long").alias("ls_n_words"),
        n_base.cast("long").alias("ls_n_base"),
        F.array_min("ls_starts").cast("long").alias("ls_first_word"),
        F.array_max("ls_starts").cast("long").alias("ls_last_word"),
        F.array_join(F.array_sort(F.array_distinct("ls_base")), ",").alias("ls_base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("ls_base", F.transform("ls_found", lambda x: x["label"])))), ",").alias("ls_labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("ls_found", lambda x: x["share"])), F.lit(0.0))).alias("ls_score"),
    )
