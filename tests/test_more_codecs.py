"""Files written and read again: exact at the depth that a format has."""

import numpy as np
import pytest

from pixelweave.sources import more_codecs
from pixelweave.sources.codecs import _bytes

RNG = np.random.default_rng(11)
IMAGE = RNG.integers(0, 256, (13, 10, 3)).astype(np.int32) * 257
DEEP = RNG.integers(0, 65536, (13, 10, 3)).astype(np.int32)


@pytest.mark.parametrize("kind", ["pcx", "sgi", "sun", "pix", "gif", "xpm", "tiff", "fits", "ico", "dpx", "tensor"])
def test_bytes_are_exact(kind):
    decode, encode = more_codecs.CODECS[kind]
    assert (decode(encode(IMAGE))[:, :, :3] == IMAGE).all()
    flat = np.full((5, 9, 3), 257 * 200, np.int32)
    assert (decode(encode(flat))[:, :, :3] == flat).all()


@pytest.mark.parametrize("kind", ["sgi", "tiff", "fits", "dpx", "tensor"])
def test_sixteen_bits_are_exact(kind):
    decode, encode = more_codecs.CODECS[kind]
    assert (decode(encode(DEEP))[:, :, :3] == DEEP).all()


def test_tiff_with_alpha_and_plain():
    p = np.concatenate([DEEP, DEEP[:, :, :1]], axis=2)
    assert (more_codecs.tiff_decode(more_codecs.tiff_encode(p)) == p).all()
    assert (more_codecs.tiff_decode(more_codecs.tiff_encode(DEEP, packed=False)) == DEEP).all()


@pytest.mark.parametrize("kind", ["wbmp", "xbm"])
def test_one_bit(kind):
    p = np.where(RNG.random((7, 19, 1)) < 0.5, 65535, 0).astype(np.int32).repeat(3, axis=2)
    decode, encode = more_codecs.CODECS[kind]
    assert (decode(encode(p)) == p).all()
    wide = np.zeros((2, 300, 3), np.int32)
    assert (decode(encode(wide)) == wide).all()


def test_hdr_is_near():
    got = more_codecs.hdr_decode(more_codecs.hdr_encode(DEEP))
    assert (np.abs(got - DEEP) <= DEEP.max(axis=2, keepdims=True) / 128 + 2).all()


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_lzw(bits):
    for n in (0, 1, 300, 9000):
        data = RNG.integers(0, 1 << bits, n).astype(np.uint8).tobytes()
        assert more_codecs.lzw_decode(more_codecs.lzw_encode(data, bits), bits) == data
    same = bytes(7000)
    assert more_codecs.lzw_decode(more_codecs.lzw_encode(same, bits), bits) == same


def test_gif_animation():
    frames = [IMAGE, 65535 - IMAGE, IMAGE[::-1]]
    got = more_codecs.gif_frames(more_codecs.gif_encode_sequence(frames, [5, 6, 7]))
    assert [f["delay"] for f in got] == [5, 6, 7]
    assert all((g["pixels"][:, :, :3] == f).all() for g, f in zip(got, frames, strict=True))


def test_many_colours_are_quantised():
    p = RNG.integers(0, 256, (60, 60, 3)).astype(np.int32) * 257
    palette, index = more_codecs.quantize(p, 64)
    assert len(palette) == 64 and index.max() < 64
    assert np.abs(palette[index].astype(int) - _bytes(p)).mean() < 25
