import collections

import numpy as np

import corpus_pipeline
from pixelweave.llm import mixing, near_dup, pieces, queries, toxicity

from .cases import no_documents, odd_documents
from .test_near_dup import brute


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = model.score(np.frombuffer("".join(rows.values()).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in rows.values()]]))
    clean = {d: t for (d, t), s in zip(rows.items(), scores, strict=True) if s < 0.5}
    kept = {c for _, c in brute(list(clean.items()))}
    mixed = mixing.mix(docs.where(docs.doc_id.isin(list(kept))), seed=queries.MIX_SEED).collect()
    want = collections.Counter({r.doc_id: int(r.mx_reps + 0.5) for r in mixed})
    codec = pieces.Codec(pieces.load(queries.piece_model()))
    got = corpus_pipeline.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in got) == +want and 50 < len(got)
    for r in got:
        assert codec.decode(np.array(r.pieces, "<i4")) == rows[r.doc_id] and r.n_pieces == len(r.pieces)


def test_stages_on_odd_rows(spark, sf):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_near_stage_keeps_one_of_each(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.union(docs)
    kept = near_dup.keep_one(twice).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()])})


def test_stages_keep_columns_of_any_names(spark, sf):
    docs = odd_documents(spark).withColumnsRenamed({"size": "pipeline_score", "score": "mx_size", "label": "nd_n"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all((r.pipeline_score, r.mx_size, r.nd_n) == ("x", "y", "z") for r in out.collect())
