"""Fingerprints and components against a plain version: every pair compared, bits counted one by one."""

import itertools
import random
import re

import numpy as np
import xxhash

from pixelweave.llm import queries, simhash

from .cases import DOCS, no_documents, odd_documents


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows of (doc_id, fingerprint) → (doc_id, fingerprint, component)."""
    distinct = sorted({f for _, f in rows})
    at = np.array(distinct, np.uint64)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(at)):
        for j in np.flatnonzero(np.bitwise_count(at[i] ^ at[i + 1 :]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    of = {f: root(i) for i, f in enumerate(distinct)}
    least = {}
    for d, f in rows:
        if d is not None:
            least[of[f]] = min(least.get(of[f], d), d)
    return sorted([(d, f"{f:016x}", least.get(of[f])) for d, f in rows], key=str)


def query(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    return sorted([tuple(r) for r in queries.op13_simhash(spark, f"file://{tmp_path}").collect()], key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted([tuple(r) for r in queries.op13_simhash(spark, sf).collect()], key=str)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == plain_components(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(20, "One two", "e", "s", 1, "x", "y", "z"), (21, "one\x0b two\n", "e", "s", 1, "x", "y", "z"), (22, "one two three four", "e", "s", 1, "x", "y", "z")], DOCS))
    got = query(spark, docs, tmp_path)
    assert got == plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])
    of = {d: c for d, _, c in got}
    assert of[2] == of[3] == of[9] == 2 and of[20] == of[21] == 20
    assert query(spark, no_documents(spark), tmp_path) == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "Cé", " ", "\n", "  \t", "xyz"]) for _ in range(4000)) + "w" * 300
    for piece in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
        assert simhash.fingerprint(b"one two") == plain_fingerprint("one two")


def test_all_links_are_found_and_a_large_group_stays_linear(spark, monkeypatch):
    """Fingerprints at every distance up to 4 from seeds, and a group of 2,000 near copies; small tiles, so cells are cut."""
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(4)
    seeds = [int(v) for v in rng.integers(0, 1 << 63, 60)] + [0, (1 << 64) - 1]
    values = set(seeds)
    for s in seeds:
        for bits in range(1, 5):
            for flip in rng.integers(0, 64, (8, bits)):
                v = s
                for b in flip:
                    v ^= 1 << int(b)
                values.add(v)
    hub = int(rng.integers(0, 1 << 63))
    values |= {hub ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(64), 2)}
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    nodes = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for _, v in rows], "fp long")
    from pixelweave.llm import common
    from pixelweave.llm.components import components

    found = simhash.edges(common.materialize(nodes, "test-nodes"))
    assert found.count() < 65 * 3 * len(rows)
    labels = {r.node % (1 << 64): r.label % (1 << 64) for r in components(found).collect()}
    groups = {}
    for i, v in rows:
        groups.setdefault(labels.get(v, v), []).append(i)
    assert sorted(map(tuple, groups.values())) == sorted(tuple(d for d, _, c in g) for g in _grouped(plain_components(rows)))


def _grouped(rows):
    by = {}
    for r in sorted(rows):
        by.setdefault(r[2], []).append(r)
    return by.values()
