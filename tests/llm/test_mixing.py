import re

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import mixing, queries

from .cases import no_documents, odd_documents


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Clamp and reshare round by round."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return sizes, out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return sizes, out


def check(rows, got):
    sizes, want = targets(rows)
    assert len(rows) == len(got)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 + 0.002 * want[s]


def mixed(docs, **options):
    return mixing.mix(docs, **options).select("doc_id", "source", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), F.col("mx_taken").alias("taken"), "mx_reps")


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixed(docs, seed=queries.MIX_SEED).collect()
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], got)
    again = queries.op9_mix(spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    other = mixed(docs, seed=1).collect()
    assert sorted((r.doc_id, r.taken) for r in other) != sorted((r.doc_id, r.taken) for r in got)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = mixed(docs)
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], out.collect())
    assert mixed(no_documents(spark)).count() == 0
    kept = mixing.repeat_rows(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(int(r.mx_reps + 0.5) for r in out.collect())
    assert mixed(docs.where("doc_id in (2, 3)")).agg(F.sum("taken")).first()[0] == 0


def test_wide_plan_joins_alike(spark, monkeypatch):
    docs = odd_documents(spark)
    want = sorted(map(str, mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixed(docs).collect())) == want


def test_columns_of_any_names_stay(spark):
    docs = odd_documents(spark).withColumnsRenamed({"size": "mx_size", "score": "mx_cell", "label": "mx_part", "n_chars": "MX_row"}).withColumn("mx_s", F.lit(1)).withColumn("mx_whole", F.lit(2))
    plain = sorted((str(r.doc_id), str(r.text)) for r in mixing.repeat_rows(odd_documents(spark)).collect())
    rows = mixing.repeat_rows(docs)
    assert rows.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in rows.collect()) == plain
    assert all(r.mx_size == "x" and r.mx_cell == "y" and r.mx_part == "z" and r.mx_s == 1 for r in rows.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == [*[c for c in docs.columns if c != "mx_size"], *mixing.OUTPUTS]
    assert all(r.mx_size == size(r.text) and r.mx_cell == "y" for r in mixed.collect())
