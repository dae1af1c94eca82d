import collections

import numpy as np
import pytest

from pixelweave.llm import common, near_dup, queries, textbytes
from pixelweave.llm.components import components

from .cases import no_documents, odd_documents


def brute(rows):
    """Classes by comparing all pairs that share a shingle."""
    texts = [(t or "").encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    word_rows, hashes, _, _ = textbytes.words(data, offsets)
    counts = np.bincount(np.unique(word_rows * near_dup.BUCKETS + near_dup.word_buckets(hashes)) % near_dup.BUCKETS, minlength=near_dup.BUCKETS)
    idf = np.log1p(len(texts) / np.maximum(counts, 1)).astype(np.float32)
    at, shingle, weight, _ = near_dup.weighted_shingles(data, offsets, idf)
    sets = [{} for _ in texts]
    for r, s, w in zip(at.tolist(), shingle.tolist(), weight.tolist(), strict=True):
        sets[r][s] = w
    holders, label = collections.defaultdict(list), list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, mine in enumerate(sets):
        for j in {j for s in mine for j in holders[s]}:
            both = sum(min(w, sets[j][s]) for s, w in mine.items() if s in sets[j])
            if both / (sum(mine.values()) + sum(sets[j].values()) - both) >= 0.8:
                label[find(i)] = find(j)
        for s in mine:
            holders[s].append(i)
    groups = collections.defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(rows[i][0])
    return sorted(((d, min(x for x in g if x is not None) if any(x is not None for x in g) else None) for g in groups.values() for d in g), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op2_near_duplicates(spark, sf).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute(rows)
    sizes = collections.Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got) and max(sizes.values()) > 5


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = near_dup.classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(r.doc_id), str(r.doc_id)) for r in docs.select("doc_id").collect())
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert near_dup.classes(no_documents(spark)).count() == 0 and near_dup.keep_one(no_documents(spark)).count() == 0


@pytest.mark.parametrize("small", [1, 100])
def test_chain_of_edits_is_one_class(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    rows = []
    for k in range(40):  # each differs from the last by a word, the first and last share little
        words[10 * k % 400] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"other{j}" for j in rng.integers(0, 10**6, 50))) for k in range(5)]
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got.items(), key=str) == brute(rows)
    assert {got[k] for k in range(40)} == {0} and all(got[100 + k] == 100 + k for k in range(5))


def test_large_groups_by_blocks(spark, monkeypatch):
    """Copies with so many edits that hardly any two are alike enough, as pairs and as blocks."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 3000, 150)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 7))):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join([*words, *(["again and again it goes"] * int(rng.integers(0, 3)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for small, block in ((1000, 256), (1, 16), (5, 40)):
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        assert sorted(((r.doc_id, r.class_id) for r in near_dup.classes(df).collect()), key=str) == want
    assert 1 < len({c for _, c in want}) < 90


def test_samples_agree_as_often_as_texts_overlap():
    rng = np.random.default_rng(0)
    n, hits, total = 300, 0, 0
    for _ in range(60):
        shingle = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        weight = rng.uniform(1, 9, len(shingle)).astype(np.float32)
        cut = len(shingle) // 3
        one = near_dup.consistent_samples(np.zeros(len(shingle), np.int64), shingle, weight)[1][0]
        two = near_dup.consistent_samples(np.zeros(len(shingle) - cut, np.int64), shingle[cut:], weight[cut:])[1][0]
        hits, total = hits + (one == two).mean(), total + weight[cut:].sum() / weight.sum()
    assert hits / 60 == pytest.approx(total / 60, abs=0.03)


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200, 202: 200}


def test_word_hash_ignores_neighbours():
    texts = [b"Alpha beta", b"beta", b"", b"xbeta betaX Beta-beta"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rows, hashes, starts, ends = textbytes.words(data, offsets)
    low = [bytes(data[a:b]).lower() for a, b in zip(starts, ends, strict=True)]
    assert rows.tolist() == [0, 0, 1, 3, 3, 3, 3] and len(set(hashes.tolist())) == len(set(low))
    assert list(common.row_chunks(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_exact_copies_without_words_are_a_class(spark):
    texts = ["!!!", "", None, "?", "!!!", " ", "", None, "!!! ", "!!!", "a word", "a  word", "!"]
    docs = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string")
    got = near_dup.classes(docs).collect()
    like = collections.defaultdict(list)
    for k, t in enumerate(texts, 10):
        like["a word" if t == "a  word" else t].append(k)
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted((k, g[0], len(g)) for g in like.values() for k in g)
    assert sorted(r.doc_id for r in near_dup.keep_one(docs).collect()) == sorted(g[0] for g in like.values())


def test_columns_of_any_names_stay(spark):
    docs = odd_documents(spark).withColumnsRenamed({"size": "nd_n", "score": "nd_key", "label": "nd_id", "n_chars": "nd_row", "lang": "raw"})
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert all((r.nd_n, r.nd_key, r.nd_id) == ("x", "y", "z") for r in kept.collect())


def test_long_path_of_edges(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(700)], "a long, b long")
    assert {r.label for r in components(edges).collect()} == {0}
