"""Manifests against a plain recursive tree, the SQL, and odd rows; traversal against whole levels."""

import hashlib
import zlib

import duckdb
import pytest

from pixelweave.llm import merkle, queries

from .cases import DOCS, no_documents, odd_documents


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text=None):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def path(tree, at):
    for nodes in tree[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        yield run[: at % 16], run[at % 16 + 1 :]
        at //= 16


def brute(rows, tamper):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in order])
    root = top[-1][0] if order else None
    for place, s in enumerate(order):
        for at, r in enumerate(by_source[s]):
            steps = [*path(trees[s], at), *path(top, place)]
            x = leaf(r, tamper(r))
            for left, right in steps:
                x = H(*left, x, *right)
            yield (r["doc_id"], leaf(r), trees[s][-1][0], root, H(*[d for left, right in steps for d in left + right]), x, x == root)


def tamper(r):
    if r["text"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5:
        return None
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])


def query(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op12_merkle(spark, f"file://{tmp_path}").collect()]


def key(r):
    return str(r)


def test_query_against_brute_force_and_sql(spark, sf):
    df = queries.op12_merkle(spark, sf)
    got = sorted(map(tuple, df.collect()), key=key)
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == sorted(brute(rows, tamper), key=key)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()['op12_merkle']})").fetchall(), key=key) == got
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    assert sorted(query(spark, docs, tmp_path), key=key) == sorted(brute([r.asDict() for r in docs.collect()], tamper), key=key)
    assert query(spark, no_documents(spark), tmp_path) == []


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096, 5000])
def test_sources_of_all_heights(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "hot", 1) for i in range(n)] + [(i, "Same", None, f"s{i % 20}", None) for i in range(40)]
    rows += [(7, "Copy", "en", None, 1)] * 300
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(5)
    assert sorted(query(spark, docs, tmp_path), key=key) == sorted(brute([r.asDict() for r in docs.collect()], tamper), key=key)


def test_more_ranges_than_writers(spark, tmp_path):
    """One task then writes several ranges, each with places of its own."""
    docs = spark.createDataFrame([(i, f"T{i}", "en", "hot", 1, "x", "y", "z") for i in range(2000)], DOCS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 9 * spark.sparkContext.defaultParallelism)
    try:
        assert sorted(query(spark, docs, tmp_path), key=key) == sorted(brute([r.asDict() for r in docs.collect()], tamper), key=key)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("n,depth", [(1, 0), (5, 1), (16, 1), (17, 2), (255, 2), (256, 2), (1000, 3)])
def test_traversal_keeps_few_nodes(n, depth):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = levels([d.hex() for d in leaves])
    way = merkle.Traversal(leaves.__getitem__, n, depth)
    for i in range(n):
        found = merkle.unpack(merkle.pack(way.path()))
        assert found == [("".join(a).encode(), "".join(b).encode()) for a, b in path(tree, i)]
        assert merkle.fold(leaves[i], found).hex() == tree[-1][0] == way.top().hex()
        kept = sum(len(r) for r in way.runs) + sum(len(t.done) + sum(map(len, t.stacks)) for t in way.next)
        assert kept <= 16 * depth * (depth + 3) / 2 + 16
        way.advance()


def test_proofs_are_kept_and_other_columns_not_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as mk_leaf", "2 as pos", "3 as g")
    rows = merkle.manifest(docs, proofs=True).collect()
    assert all(r.mk_verified for r in rows)
    for r in rows:
        assert merkle.fold(bytes.fromhex(r.mk_leaf), merkle.unpack(bytes(r.mk_proof))).hex() == r.mk_root
