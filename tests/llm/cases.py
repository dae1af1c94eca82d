"""Rows that every operator has to bear: nulls, empty and long texts, ties, repeated rows, clashing column names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, label string"


def odd_documents(spark):
    rows = [
        (1, "All rights reserved. Licensed under the Apache License, Version 2.0", "en", "a", 1),
        (1, "All rights reserved. Licensed under the Apache License, Version 2.0", "en", "a", 1),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (4, "word " * 30_000, "en", "b", 5),
        (5, "cc by cc by CC-BY general public license", "en", "b", 5),
        (6, "x\n\n y\t\tz     end  ", "en", None, 5),
        (None, "no id here at all my friend", "en", "c", 5),
        (7, "Äöü ßß ééé \U0001f600 emoji", "de", "", 5),
        (8, "GNU General Public License, version 3 this work is licensed under the", "en", "z", 5),
        (9, " ", "en", "z", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
