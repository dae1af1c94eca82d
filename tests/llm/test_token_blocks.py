import zlib

import numpy as np
import pytest

from pixelweave.llm import queries, token_blocks

from .cases import no_documents, odd_documents


@pytest.mark.parametrize("percentile", [0.5, 0.9, 1.0])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(1)
    for ids in ([], [5], [2**32 - 1, 0], rng.integers(0, 50_000, 1000), np.where(rng.random(700) < 0.02, 2**31, 7), np.full(129, 9), rng.integers(0, 2**32, 300)):
        ids = np.array(ids, np.uint64)
        packed, starts = token_blocks.pack_blocks(ids, percentile)
        assert (token_blocks.unpack_blocks(np.frombuffer(packed, np.uint8), starts, len(ids)) == ids).all()


def test_any_block_alone():
    ids = np.arange(1000, dtype=np.uint64) ** 2
    packed, starts = token_blocks.pack_blocks(ids)
    assert (token_blocks.unpack_blocks(np.frombuffer(packed, np.uint8), starts[3:4], 128) == ids[384:512]).all()


def brute(rows, end_id=2):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(queries.byte_bpe()), 0, []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert [tuple(r) for r in queries.op1_token_blocks(spark, sf).orderBy("doc_id").collect()] == brute(rows)


def test_odd_rows_and_small_files(spark):
    docs = odd_documents(spark)
    path = token_blocks.write_token_files(docs, queries.byte_bpe, partitions=3, file_tokens=50)
    got = token_blocks.read_token_files(spark, path).orderBy("start").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [tuple(r)[:4] for r in got] == brute(rows)
    assert len({r.file for r in got}) > 3


def test_no_rows(spark):
    path = token_blocks.write_token_files(no_documents(spark), queries.byte_bpe)
    assert token_blocks.read_token_files(spark, path).count() == 0


def encoded(texts, encoder=None):
    raw = [t.encode() for t in texts]
    ids, counts = (encoder or token_blocks.PieceEncoder(queries.byte_bpe())).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def whole(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(queries.byte_bpe()).encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_whole():
    texts = ["a  b", " a", "a ", "a \n b", "it's  'x' don't", "\n\n a  b c  d", "1 2  33 ,, ;;  <|endoftext|> x", "tab\t x \t\ty", "\x1c a \x1f  b", "é è  ÿ", "", "\n", "\n\nx", "x\n", "a\x00", "a", "a\u00a0\n\nb", "e\u0301's×÷ ß%é's", "\u3000 x\u2003\n y\x85\n\nz", "日本語、テキスト。 " * 20, "x" * 24, "x" * 23, "  \nfoo", "foo\n'bar"]
    assert encoded(texts) == whole(texts)


def test_random_texts_equal_whole(monkeypatch):
    rng = np.random.default_rng(4)
    signs = np.array(list("abZé×ß09 '%.,\n\t\r-_\u00a0\u0301\u3000日\x1c\x85\x00ſİ²½٣") + ["  ", "'s", "'ll", " '", "\n\n", "word", " the"])
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(3000)]
    want = whole(texts)
    assert encoded(texts) == want
    monkeypatch.setattr(token_blocks, "CACHE_SLOTS", 256)  # generations change all the time
    encoder = token_blocks.PieceEncoder(queries.byte_bpe())
    encoder.table = token_blocks.PieceTable(256)
    monkeypatch.setattr(token_blocks.PieceTable.__init__, "__defaults__", (256,))
    assert [encoded(texts[a : a + 50], encoder) for a in range(0, 3000, 50)] == [want[a : a + 50] for a in range(0, 3000, 50)]
