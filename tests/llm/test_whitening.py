"""Whitening against exact integers and an independent eigen-solver; odd rows; the tree of states."""

from fractions import Fraction

import numpy as np
import pytest

from pixelweave.llm import queries, whitening


def _rows(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "x") for i, v in zip(ids or range(len(vectors)), vectors)], "vec_id long, embedding array<float>, wh_vector string")


def test_query_against_brute_force(spark, sf):
    got = queries.op11_whitening(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(table.embedding.to_numpy()).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    assert (got.n == n).all() and len(got) == 32 * n and sorted(set(got.component)) == list(range(1, 33))
    deviation = dict(zip(table.vec_id.tolist(), [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]))
    assert all(deviation[i] == d for i, d in zip(got.vec_id, got.deviation))
    centred = x - s / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    assert np.allclose(got.groupby("component").explained.first(), e[:32] / np.trace(v), rtol=1e-9)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    want = centred @ q[:, :32] / np.sqrt(e[:32])
    signs = np.sign((wide * want).sum(0))
    assert np.abs(wide - want * signs).max() < 1e-7
    own = np.abs(wide.T @ wide / n - np.eye(32)).max()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-6 and abs(got.identity_error[0] - own) < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 17, 80])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    for m in (a + a.T, a @ a.T, np.eye(d), np.zeros((d, d)), np.diag(np.arange(d) % 3.0), np.outer(a[0], a[0])):
        e, q = whitening.symmetric_qr(m)
        scale = max(np.abs(m).max(), 1e-300)
        assert np.allclose(e, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * scale * d)
        assert np.abs(q.T @ q - np.eye(d)).max() < 1e-12 and np.abs(m @ q - q * e).max() < 1e-12 * scale * d


def test_states_of_many_partitions_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_STATES", 2)
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(500, 6)) * [9, 5, 3, 2, 1, 0.5] + 7).astype(np.float32)
    rows, model = whitening.whiten(_rows(spark, v.tolist()).repartition(37))
    x = np.floor(64 * v.astype(np.float64)) + 1_000_000
    assert model.n == 500 and model.sums == x.astype(int).sum(0).tolist()
    assert np.allclose(model.explained, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1] / np.trace(np.cov(x.T, bias=True)), rtol=1e-10)
    assert model.identity_error < 1e-9 and rows.count() == 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [1.0, None], [nan, 1.0], [inf, 0.0], [], [3.0, -1.0], [3.0, -1.0], [0.0, 0.0], [1.0, 2.0, 3.0]]
    rows, model = whitening.whiten(_rows(spark, vectors, [1, 2, 3, 4, 5, 6, 7, 7, None, 10]))
    got = rows.collect()
    assert rows.columns == ["vec_id", "embedding", "wh_vector", "wh_deviation"]
    assert sorted(str(r.vec_id) for r in got) == ["1", "7", "7", "None"] and model.n == 4
    x = [[64, 128], [192, -64], [192, -64], [0, 0]]
    mean = [Fraction(sum(c), 4) for c in zip(*x)]
    assert sorted(r.wh_deviation for r in got) == sorted(sum((4 * (a - m)) ** 2 for a, m in zip(r, mean)) for r in x)
    assert model.identity_error < 1e-9


def test_no_variance_and_empty(spark):
    rows, model = whitening.whiten(_rows(spark, [[5.0, 5.0]] * 3))
    assert [r.wh_vector for r in rows.collect()] == [[None, None]] * 3 and model.explained == [0.0, 0.0] and model.identity_error == 0
    one_way, model = whitening.whiten(_rows(spark, [[float(i), float(i)] for i in range(9)]))
    assert model.identity_error < 1e-9 and all(r.wh_vector[1] is None and r.wh_vector[0] is not None for r in one_way.collect())
    for vectors in ([], [None], [[]]):
        rows, model = whitening.whiten(_rows(spark, vectors))
        assert rows.collect() == [] and model.n == 0


def test_large_entries(spark):
    rows, model = whitening.whiten(_rows(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0], [1e9, 1e9]]))
    got = rows.collect()
    assert [r.wh_deviation for r in got] == [None] * 4 and all(np.isfinite(v) for r in got for v in r.wh_vector if v is not None)
