import time

import numpy as np

from pixelweave.llm import ann, maxscore, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def table(rows):
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


def highest(ids, w, q, k=10):
    s = w @ w[q]
    return [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    ids, x = table(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    got = by_query(queries.op4_nearest_neighbours(spark, sf).collect())
    hits = 0
    asked = np.flatnonzero(ids % 100 == 0)
    for q in asked:
        want = dict(nearest(ids, x, q))
        mine = got[int(ids[q])]
        assert len(mine) == 10 and mine == sorted(mine, key=lambda z: (z[1], z[0]))
        for v, s in mine:
            assert abs(s - np.sqrt(((x[ids == v][0] - x[q]) ** 2).sum())) < 1e-12
        hits += sum(v in want for v, _ in mine)
    assert hits >= 0.95 * 10 * len(asked)


def test_maxscore_is_exact(spark):
    sf = "/root/testdata/sf0.1"
    ids, x = table(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect())
    w = np.floor(x * 1024).astype(np.int64)
    got = by_query(queries.op6_maxscore(spark, sf).collect())
    assert got == {int(ids[q]): highest(ids, w, q) for q in np.flatnonzero(ids % 100 == 0)}


def test_maxscore_on_sparse_postings():
    rng = np.random.default_rng(5)
    for trial in range(12):
        w = np.where(rng.random((600, 40)) < 0.1, rng.integers(-3 if trial % 2 else 0, 9, (600, 40)), 0)
        ids = rng.permutation(2000)[:600]
        shard = maxscore.Shard(ids, w)
        for q in range(0, 600, 60):
            assert [(d, s) for s, d in shard.top(w[q], int(ids[q]), 10)] == highest(ids, w, q)


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, [1.0, 2.0, 3.0]), (800, []), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0])]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def test_odd_rows(spark):
    asked = lambda c: c % 100 == 0
    got = by_query(ann.search(odd(spark), asked).collect())
    half = np.sqrt(0.5)
    assert got == {0: [(100, 0.0), (1, half), (1, half), (2, half), (3, 2.0)], 100: [(0, 0.0), (1, half), (1, half), (2, half), (3, 2.0)]}
    got = by_query(maxscore.search(odd(spark), asked).collect())
    assert got[0] == [(100, 1048576), (1, 524288), (1, 524288), (2, 524288), (300, 0), (3, -1048576)]
    assert [v for v, _ in got[300]] == [0, 1, 1, 2, 3, 100]
    for search in (ann.search, maxscore.search):
        assert search(odd(spark).limit(0), asked).count() == 0
        assert search(odd(spark).where("vec_id = 0"), asked).count() == 0


def test_same_vector_everywhere(spark):
    rows = spark.createDataFrame([(k, [0.25, 0.5]) for k in range(500)], "vec_id long, embedding array<float>")
    for search in (ann.search, maxscore.search):
        got = by_query(search(rows, lambda c: c % 100 == 0).collect())
        assert [v for v, _ in got[100]] == list(range(10)) and [v for v, _ in got[0]] == list(range(1, 11))


def test_graph_finds_the_nearest():
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((700, 16))
    x = rng.standard_normal((200, 16))
    ids, near = ann.Graph.build(centers).search(x, 10, 64)
    true = np.argsort(ann.squared(x, centers), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 9.5
    assert (np.diff(near, axis=1) >= 0).all()
    sizes = np.bincount(ann.squared(x, ann.fit_centroids(x.copy(), 10)).argmin(axis=1), minlength=10)
    assert sizes.max() <= 60


def clustered(n, dims, seed):
    """Gauss vectors, a third of them copies of one, with ids in random order."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[: n // 3] = x[0]
    return rng.permutation(3 * n)[:n], x.astype(np.float32).astype(np.float64)


def test_every_query_has_all_ranks(spark):
    ids, x = clustered(3000, 8, 3)
    ids[1000:1040] = 100 * np.arange(100_000, 100_040)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = by_query(ann.search(rows, lambda c: c >= 10_000_000).collect())
    assert len(got) == 40
    for q in range(1000, 1040):
        want = nearest(ids, x, q)
        assert [v for v, _ in got[int(ids[q])]] == [v for v, _ in want]


def test_recall_in_few_dimensions_and_among_copies(spark):
    for copies in (False, True):
        ids, x = clustered(20_000, 8, 4)
        if not copies:
            x = np.random.default_rng(6).standard_normal(x.shape).astype(np.float32).astype(np.float64)
        asked = set(ids[-60:].tolist())
        rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
        got = by_query(ann.search(rows, lambda c: c.isin(asked)).collect())  # noqa: B023
        hits = sum(len(dict(nearest(ids, x, q)).keys() & dict(got[int(ids[q])]).keys()) for q in range(len(ids) - 60, len(ids)))
        assert hits >= 0.95 * 10 * 60, (copies, hits)


def test_maxscore_of_large_components(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 4)).astype(np.float32).astype(np.float64)
    x[::7] *= 200_000
    x[3] = [2.0**20, 0.0, 0.0, 0.0]
    x = x.astype(np.float32).astype(np.float64)
    ids = rng.permutation(300)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = by_query(maxscore.search(rows, lambda c: c % 5 == 0).collect())
    w = np.array([[int(np.floor(c * 1024)) for c in v] for v in x], object)
    assert got == {int(ids[q]): [(int(ids[j]), int(w[j] @ w[q])) for j in sorted(range(300), key=lambda j: (-int(w[j] @ w[q]), ids[j])) if j != q][:10] for q in np.flatnonzero(ids % 5 == 0)}  # noqa: B023


def test_rows_of_one_id_are_rows_each(spark):
    rng = np.random.default_rng(12)
    rows = [(int(k), rng.integers(-9, 9, 3).astype(float).tolist()) for k in rng.integers(1, 40, 150)] + [(0, [1.0, 2.0, 3.0]), (0, [3.0, -1.0, 2.0]), (0, [1.0, 2.0, 3.0])]
    rows = [(k, v) for k, v in rows if any(v)]
    table = spark.createDataFrame([(*r, 9, 9) for r in rows], "vec_id long, embedding array<float>, row long, ask long")
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    own = [j for j, (k, _) in enumerate(rows) if k == 0]

    def lists(got):
        got = sorted((r.rank, r.vec_id, r.score) for r in got)
        assert len(got) == 10 * len(own)
        return got

    def best(key):
        out = []
        for q in own:
            ranked = sorted((key(j, q), ids[j]) for j in range(len(rows)) if j != q)[:10]
            out += [(n, int(v), abs(s) if key is far else -s) for n, (s, v) in enumerate(ranked, 1)]
        return sorted(out)

    far = lambda j, q: float(np.sqrt(((x[j] - x[q]) ** 2).sum()))
    inner = lambda j, q: -int((np.floor(1024 * x[j]) * np.floor(1024 * x[q])).sum())
    assert lists(ann.search(table, lambda c: c == 0).collect()) == best(far)
    assert lists(maxscore.search(table, lambda c: c == 0).collect()) == best(inner)


def test_few_rows_far_from_all_others(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 8))
    x[:4] += 1000
    centers = ann.fit_centroids(x.copy(), 700)
    assert np.isfinite(centers).all() and len(centers) == 700
    x = x.astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = by_query(ann.search(rows, lambda c: (c < 2) | (c % 1000 == 17)).collect())
    hits = 0
    for q, mine in got.items():
        assert len(mine) == 10
        hits += len(dict(nearest(np.arange(6000), x, q)).keys() & dict(mine).keys())
    assert len(got) == 8 and hits >= 0.95 * 80


def test_rows_of_one_id_beyond_the_sample(spark):
    """2,000 rows of query id 100 and some of id 7, with samples of 50: every row is found a neighbour by, none is lost."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((2020, 4))
    rows = [(100 if k < 2000 else 7, [float(x) for x in np.float32(r)]) for k, r in enumerate(v)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(table, lambda c: c % 100 == 0, sample=50).collect()
    assert len(got) == 20_000 and sorted({r["rank"] for r in got}) == list(range(1, 11))
    x = np.float32(v).astype(np.float64)
    d = np.sqrt(((x[:2000, None] - x[None]) ** 2).sum(2))
    d[np.arange(2000), np.arange(2000)] = np.inf
    best = np.sort(d, 1)[:, :10].ravel()
    found = np.sort(np.array([r.score for r in got]))
    assert np.isclose(found, np.sort(best)).mean() > 0.9


def test_repeated_queries_are_not_sent_through_the_driver(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(-i)]) for i in range(300)], "vec_id long, embedding array<double>")
    plan = maxscore.search(rows, lambda v: v % 100 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_narrow_integers_are_the_same():
    for v in ([], [0], [127, -128], [128], [-129], [32767, -32768], [32768], [2**31], [-(2**40)]):
        w = np.array(v, np.int64)
        assert (maxscore.narrow(w).astype(np.int64) == w).all()
    assert maxscore.narrow(np.array([[3, -4]])).dtype == np.int8


def test_many_queries_share_the_postings_of_a_shard():
    """All queries of a part are answered together: the same lists as one by one, in far less time."""
    rng = np.random.default_rng(11)
    for most, share in ((1000, 1.0), (3, 1.0), (9, 0.1), (2**26, 1.0)):
        w = np.where(rng.random((3000, 40)) < share, rng.integers(-most, most, (3000, 40)), 0)
        ids = rng.integers(0, 2000, 3000)
        own, asked = np.arange(3000), np.arange(0, 3000, 30)
        shard = maxscore.Shard(ids, w, own)
        start = time.process_time()
        found = list(zip(*(c.tolist() for c in shard.tops(w[asked], own[asked], 10)), strict=True))
        middle = time.process_time()
        assert found == [(n, *row) for n, q in enumerate(asked) for row in shard.top(w[q], q, 10)]
        if share == 1 and most == 1000:
            assert middle - start < (time.process_time() - middle) / 2
        scores = w @ w[asked].T
        for n, q in enumerate(asked):
            best = [(n, int(scores[j, n]), int(ids[j])) for j in np.lexsort((ids, -scores[:, n])) if j != q][:10]
            assert [row for row in found if row[0] == n] == best
