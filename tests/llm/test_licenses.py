import re

from pixelweave.llm import licenses, queries

from .cases import no_documents, odd_documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def check(rows, got):
    want = []
    for doc_id, text in rows:
        b, f = base(text), whole(text)
        labels = ",".join(sorted(set(b[4].split(",")) - {""} | set(f)))
        want.append((doc_id, *b, labels, 1.0 if b[1] else max(f.values(), default=0.0)))
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = check(rows, [tuple(r) for r in queries.op8_license_scan(spark, sf).collect()])
    assert {"mit", "apache-2.0"} <= {x for w in want for x in w[6].split(",")}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    extra = [(20, "Released under the MIT License license license. released under the mit license"), (21, "gnu license"), (22, "Permission is hereby granted, free of charge, to anyone")]
    docs = docs.select("doc_id", "text", "score", "label").union(spark.createDataFrame([(*e, "a", "b") for e in extra], "doc_id long, text string, score string, label string"))
    got = licenses.scan(docs)
    assert got.columns[:4] == docs.columns
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], [(r[0], *r[4:]) for r in got.collect()])
    assert licenses.scan(no_documents(spark)).count() == 0


def whole(text):
    """Labels and shares by plain search over all offsets: no words are looked up, so none can be cut."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    out = {}
    for label, body, phrases in licenses.TEMPLATES:
        b = body.split()
        for o in range(-len(b), len(w)):
            placed = [0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(b)]
            keys = all(any(b[k : k + len(p)] == p and all(placed[k : k + len(p)]) for k in range(len(b) - len(p) + 1)) for p in (p.split() for p in phrases))
            if keys and sum(placed) / len(b) >= licenses.LEAST_SHARE:
                out[label] = max(out.get(label, 0), sum(placed) / len(b))
    return out


def test_many_licences_in_a_text(spark):
    notices = [body for _, body, _ in licenses.TEMPLATES]
    fee = "x to use copy x and or x this x for any purpose with or without fee is x x x permission modify"
    texts = ["\n\n".join(notices), " filler words ".join(notices[::-1]), "\n".join(notices[i] for i in (0, 2, 7)), "\n".join(notices[i] for i in (0, 7, 2, 9, 8)), *notices, fee, " and ".join(sorted(licenses.vocabulary()))]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        want = whole(r.text)
        assert set(r.ls_labels.split(",")) - {""} == set(want) | (set(r.ls_base_labels.split(",")) - {""})
        assert r.ls_score == (1.0 if r.ls_n_base else max(want.values(), default=0.0))
        if r.doc_id % len(texts) == 0:
            assert set(want) == {label for label, _, _ in licenses.TEMPLATES}


def test_columns_of_any_names_stay(spark):
    docs = odd_documents(spark).withColumnsRenamed({"size": "ls_words", "score": "ls_score", "label": "ls_found", "n_chars": "LS_row"})
    got = licenses.scan(docs)
    assert got.columns == [*[c for c in docs.columns if c != "ls_score"], *licenses.OUTPUTS]
    for r in got.collect():
        assert r.ls_words == "x" and r.ls_found == "z" and (r.ls_n_words, r.ls_n_base, r.ls_first_word, r.ls_last_word, r.ls_base_labels) == base(r.text)


def test_tags_and_the_usual_notices(spark):
    cases = {
        "// SPDX-License-Identifier: MIT": "mit",
        "# SPDX-License-Identifier: Apache-2.0 OR BSD-3-Clause": "apache-2.0",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY': "mit",
        "SPDX License: MIT": "",
        "the mit licence of software without warranty": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.text: r.ls_labels for r in licenses.scan(docs).collect()} == cases


def test_the_rarest_key_words_are_looked_up():
    counts = dict.fromkeys(licenses.vocabulary(), 100) | {"mit": 3, "identifier": 2, "spdx": 1, "eclipse": 0}
    looked_up = licenses.anchors(counts)
    at = {body: a for (_, body, _), a in zip(licenses.TEMPLATES, looked_up, strict=True)}
    assert at["spdx license identifier mit"] == (("spdx", 0), ("identifier", 2))
    assert at["released under the mit license"] == (("mit", 3), ("license", 4))
    assert at["the terms of the eclipse public license"] is None
    assert at["licensed under cc by nc 4 0"] is not None
