"""Cleaning a corpus: toxic documents go, one of each near-duplicate class stays, sources are mixed, texts become pieces.

``STAGES`` are applied in order to the table ``documents``; each stage's result is written as Parquet and read again.
Each reads whole texts of any length and bears nulls in any column, repeated rows, empty tables and columns of any
further names, which all but the last stage return as they are; the operators' docstrings say what comes of each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import common, mixing, near_dup, pieces, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labelled rows stay; an empty or null text has the score of no words."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.unused(docs.columns, "pipeline_score")
    scored = toxicity.add_score(docs, model, score)
    return scored.where(F.col(score) < 0.5).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near-duplicates stays; of null texts, and of exact copies without words, one."""
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix repeats it (none, once or twice); a null source is a source of its own."""
    return mixing.repeat_rows(docs, seed=queries.MIX_SEED)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and the piece ids of every row; a null or empty text has none."""
    return pieces.encode(docs, queries.piece_model())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("pieces", to_pieces)]

#: A trained classifier, sampled hashes and a segmentation: not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
