"""Fax coding of two-level images: modified Huffman rows, group 3 (rows, or rows against the row above) and group 4."""

from __future__ import annotations

import bisect

import numpy as np

#: Fixed values of the standard: codes of white and of black runs of 0 to 63 pixels, of 64 to 1728 by 64, and of both from 1792 on.
WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100".split()
WHITE_LONG = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011".split()
BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111".split()
BLACK_LONG = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101".split()
LONGEST = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
EOL = "000000000001"
#: Modes of a row against the row above; a number is how far right of the change above the change lies.
PASS, HORIZONTAL = "pass", "horizontal"
MODES = {"0001": PASS, "001": HORIZONTAL, "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
PEEK = 13


def _runs(short: list[str], long: list[str]) -> dict[str, int]:
    return {c: k for k, c in enumerate(short)} | {c: 64 * (k + 1) for k, c in enumerate(long + LONGEST)}


RUNS = (_runs(WHITE, WHITE_LONG), _runs(BLACK, BLACK_LONG))


def _table(codes: dict[str, object]) -> list[tuple[object, int] | None]:
    """Of every PEEK bits the code they begin with and its length."""
    out: list[tuple[object, int] | None] = [None] * (1 << PEEK)
    for code, value in codes.items():
        first = int(code, 2) << PEEK - len(code)
        out[first : first + (1 << PEEK - len(code))] = [(value, len(code))] * (1 << PEEK - len(code))
    return out


_TABLES = [_table(r) for r in RUNS]
_MODE_TABLE = _table(MODES)


class Ended(Exception):
    """No further code of the kind asked for: an end of data or of the page."""


class Reader:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
        # the PEEK bits from each place on
        wide = np.concatenate([self.bits, np.zeros(PEEK, np.uint8)]).astype(np.int32)
        self.ahead = sum((wide[k : k + len(self.bits)] << PEEK - 1 - k for k in range(PEEK)), np.zeros(len(self.bits), np.int32)).tolist()

    def read(self, table: list) -> object:
        found = table[self.ahead[self.at]] if self.at < len(self.ahead) else None
        if found is None:
            raise Ended
        self.at += found[1]
        return found[0]

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.read(_TABLES[color])
            total += n
            if n < 64:
                return total

    def skip_eol(self) -> bool:
        """Past an end of line and the fill bits before it, if they come next."""
        at = self.at
        while at < len(self.bits) and not self.bits[at]:
            at += 1
        if at - self.at >= len(EOL) - 1 and at < len(self.bits):
            self.at = at + 1
            return True
        return False


def _row(reader: Reader, width: int) -> list[int]:
    """Places of the changes of a row coded by itself, from white."""
    changes, at, color = [], 0, 0
    while at < width:
        at += reader.run(color)
        changes.append(min(at, width))
        color ^= 1
    return changes


def _row_against(reader: Reader, above: list[int], width: int) -> list[int]:
    changes: list[int] = []
    at, color = -1, 0
    while at < width:
        # the first change above to the right, from this row's colour to the other
        k = bisect.bisect_right(above, at)
        k += (k ^ color) & 1
        b1 = above[k] if k < len(above) else width
        mode = reader.read(_MODE_TABLE)
        if mode == PASS:
            at = above[k + 1] if k + 1 < len(above) else width
        elif mode == HORIZONTAL:
            first = max(at, 0) + reader.run(color)
            at = first + reader.run(color ^ 1)
            changes += [min(first, width), min(at, width)]
        else:
            at = min(max(b1 + mode, 0), width)
            changes.append(at)
            color ^= 1
    return changes


def _real(changes: list[int], width: int) -> list[int]:
    """Without the bounds of empty runs and the end of the row."""
    out: list[int] = []
    for c in changes:
        if out and out[-1] == c:
            out.pop()
        else:
            out.append(c)
    return [c for c in out if c < width]


def decode(data: bytes, width: int, height: int, kind: int, two_dimensional: bool = False, byte_aligned: bool = False) -> np.ndarray:
    """(height, width) of 0 (white) and 1 (black). ``kind``: 2 modified Huffman, 3 group 3, 4 group 4; rows that are missing are white."""
    reader, out = Reader(data), np.zeros((height, width), np.uint8)
    above: list[int] = []
    for y in range(height):
        try:
            flat = kind != 4
            if kind == 3:
                reader.skip_eol()
                if two_dimensional:
                    flat = reader.at < len(reader.bits) and bool(reader.bits[reader.at])
                    reader.at += 1
            if kind == 2 or byte_aligned and kind == 4:
                reader.at += -reader.at % 8
            changes = _row(reader, width) if flat else _row_against(reader, above, width)
        except Ended:
            break
        above = _real(changes, width)
        step = np.zeros(width + 1, np.uint8)
        step[above] = 1
        out[y] = np.cumsum(step[:width]) & 1
    return out


# --- writing ------------------------------------------------------------------------------------------------------------------------

_CODES = [{n: c for c, n in r.items()} for r in RUNS]
_MODE_CODES = {m: c for c, m in MODES.items()}


def _run_code(n: int, color: int) -> str:
    out = ""
    while n >= 2560 + 64:
        out, n = out + _CODES[color][2560], n - 2560
    if n >= 64:
        out, n = out + _CODES[color][n // 64 * 64], n % 64
    return out + _CODES[color][n]


def _encode_row(changes: list[int], width: int) -> str:
    ends = [0, *changes, width]
    return "".join(_run_code(b - a, k & 1) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)))


def _encode_against(changes: list[int], above: list[int], width: int) -> str:
    out, at, color = [], -1, 0
    while at < width:
        k = bisect.bisect_right(above, at)
        k += (k ^ color) & 1
        b1, b2 = (above[j] if j < len(above) else width for j in (k, k + 1))
        j = bisect.bisect_right(changes, at)
        j += (j ^ color) & 1
        a1, a2 = (changes[i] if i < len(changes) else width for i in (j, j + 1))
        if b2 < a1:
            out.append(_MODE_CODES[PASS])
            at = b2
        elif abs(a1 - b1) <= 3:
            out.append(_MODE_CODES[a1 - b1])
            at, color = a1, color ^ 1
        else:
            out.append(_MODE_CODES[HORIZONTAL] + _run_code(a1 - max(at, 0), color) + _run_code(a2 - a1, color ^ 1))
            at = a2
    return "".join(out)


def encode(black: np.ndarray, kind: int, two_dimensional: bool = False, parameter: int = 4) -> bytes:
    """Rows of 0 (white) and 1 (black); in two-dimensional group 3 each ``parameter``-th row stands by itself."""
    h, w = black.shape
    rows = [(np.flatnonzero(np.diff(np.concatenate(([0], r.astype(np.int8)))))).tolist() for r in black]
    out: list[str] = []
    for y, changes in enumerate(rows):
        if kind == 4:
            out.append(_encode_against(changes, rows[y - 1] if y else [], w))
        elif kind == 2:
            code = _encode_row(changes, w)
            out.append(code + "0" * (-len(code) % 8))
        elif two_dimensional:
            flat = y % parameter == 0
            out.append(EOL + ("1" + _encode_row(changes, w) if flat else "0" + _encode_against(changes, rows[y - 1], w)))
        else:
            out.append(EOL + _encode_row(changes, w))
    if kind == 4:
        out.append(EOL * 2)
    elif kind == 3:
        out.append((EOL + "1" if two_dimensional else EOL) * 6)
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:] if text else b""
