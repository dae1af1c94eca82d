"""Registered queries against their SQL in DuckDB, at the smallest size, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from pixelweave import catalog

NAMES = sorted(catalog.oracle_sql())
#: Every family has a few of its queries here; the driver compares all of them.
CHOSEN = [n for k, n in enumerate(NAMES) if k % 6 == 0 or n in ("equalize", "otsu", "trim", "similar_images", "steps_halo", "resize_lanczos3", "codec_png", "fx_ternary", "apply_hald", "match_histogram")]


def rows(values):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else v for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for table in ("embeddings", "events", "documents", "pages"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]}) q").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.queries()) > 250


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
