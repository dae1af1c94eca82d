import numpy as np
import pytest

from pixelweave.llm import pieces, queries

from .cases import no_documents, odd_documents


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(queries.piece_model()))


def usable(v):
    of_bytes = set(v.byte.tolist())
    return {t: k for k, t in enumerate(v.text) if t and k not in of_bytes}


def best(v, text, index=None):
    """Best sum of scores by trying every piece at every place."""
    index = index or usable(v)
    score, ids = [0.0] + [-np.inf] * len(text), [[]] + [None] * len(text)
    for i in range(len(text)):
        if ids[i] is None:
            continue
        for j in range(i + 1, len(text) + 1):
            k = index.get(text[i:j].encode())
            value = v.score[k] if k is not None else v.unknown if j == i + 1 else None
            if value is not None and score[i] + value > score[j]:
                score[j], ids[j] = score[i] + value, [*ids[i], *([k] if k is not None else v.byte[list(text[i:j].encode())].tolist())]
    return ids[-1]


@pytest.mark.parametrize("text", ["Hello world", "the theatre with of it", "naïve café 日本語 😀", "\tx\n\ny", "  two  spaces ", "aaaaaaaaaaaaaaaa", "", " "])
def test_best_segmentation(codec, text):
    ids = np.frombuffer(next(codec.encode([text])), "<i4")
    assert ids.tolist() == (best(codec.v, pieces.MARK + text.replace(" ", pieces.MARK)) if text else [])
    assert codec.decode(ids) == text


@pytest.mark.parametrize("text", ["▁", "a▁▁b ▁c", "▁ ▁", "\x00\x01", "퟿￿", "x" * 5000, "é▁" * 50])
def test_round_trip(codec, text):
    assert codec.decode(np.frombuffer(next(codec.encode([text])), "<i4")) == text


def test_trie_holds_exactly_its_pieces():
    words = {b"a": 0, b"ab": 1, b"abc": 2, b"b\xff": 3, b"\x00": 4}
    base, check, piece = pieces.build_trie(words)

    def find(word):
        s = 0
        for b in word:
            t = base[s] + b
            if check[t] != s:
                return -1
            s = t
        return piece[s]

    assert {w: find(w) for w in words} == words
    assert find(b"ac") == find(b"b") == find(b"abcd") == find(b"\xff") == -1


def test_runs_of_marks_stay_together(codec):
    v = pieces.load(queries.piece_model(), lambda k, s: -1.0 if s < -1e8 else s)
    for some in (pieces.Codec(v), codec):
        assert some.v.runs and not some.v.inner
        for text in ("a   b", "   ", " x", "a b  c    d", "x  ", " ", "a " * 40):
            ids = np.frombuffer(next(some.encode([text])), "<i4")
            assert ids.tolist() == best(some.v, pieces.MARK + text.replace(" ", pieces.MARK)) and some.decode(ids) == text


def test_pieces_across_words(codec):
    """A vocabulary with a piece that holds a marker between characters: the whole text is one word."""
    v = codec.v
    known, number = usable(v), len(v.text)
    known["\u2581of\u2581the".encode()] = number
    trie = pieces.build_trie(known)
    wide = pieces.Vocabulary(*trie, np.append(v.score, 5.0), v.byte, [*v.text, "\u2581of\u2581the".encode()], v.unknown, v.runs, True)
    for text in ("one of the  best", "of the", "a"):
        ids = np.frombuffer(next(pieces.Codec(wide).encode([text])), "<i4")
        assert ids.tolist() == best(wide, pieces.MARK + text.replace(" ", pieces.MARK)) and pieces.Codec(wide).decode(ids) == text
        assert (number in ids) == ("of the" in text)


def test_whole_table_equals_brute_force(spark, sf, codec):
    import zlib

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    cache, index = {}, usable(codec.v)

    def whole(text):
        out = []
        for w in text.split(" "):  # no piece reaches over a marker beyond its front, and no text of this table has two spaces in a row
            if w not in cache:
                cache[w] = best(codec.v, pieces.MARK + w, index)
            out += cache[w]
        return out if text else []

    got = {r.doc_id: r for r in queries.op7_pieces(spark, sf).collect()}
    checked = 0
    for doc_id, text in rows:
        if max(map(len, text.split(" "))) > 60 or "  " in text or text.startswith(" ") or text.endswith(" ") or len(text) > 20_000 or pieces.MARK in text:
            continue
        ids = whole(text)
        assert got[doc_id].n_pieces == len(ids) and got[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())
        checked += 1
    assert checked > 0.5 * len(rows)


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op7_pieces(spark, sf).collect()
    assert len(got) == docs.count() and all(r.round_trip and r.n_pieces > 0 for r in got)
    codec = pieces.Codec(pieces.load(queries.piece_model()))
    rows = {r.doc_id: r for r in pieces.encode(odd_documents(spark), queries.piece_model()).collect()}
    for r in odd_documents(spark).collect():
        ids = np.array(rows[r.doc_id].pieces, "<i4")
        assert codec.decode(ids) == (r.text or "") and rows[r.doc_id].n_pieces == len(ids)
    assert rows[2].n_pieces == rows[3].n_pieces == 0
    assert pieces.encode(no_documents(spark), queries.piece_model()).count() == 0
    assert all(r.round_trip for r in pieces.digest(odd_documents(spark), queries.piece_model()).collect())
