"""Vectorised hashing of words, prefixes and shingles over Arrow text buffers.

Words are hashed from prefix sums of a polynomial over the bytes (mod 2**64, then a bit mixer),
so the cost is a few array passes a byte and no Python object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a key counts."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(size).bit_length()))


def spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the spans one after another, and the span of each."""
    n = end - begin
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + (begin - np.cumsum(n) + n)[own], own


@dataclass
class Words:
    """Words of a run of texts: hash, text index, first and past-last byte; ``first`` is where each text's words begin."""

    hashes: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def prefix(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``length`` bytes of the words that are at least that long, and which words they are."""
        at = np.flatnonzero(self.end - self.begin >= length)
        start = self.begin[at]
        value = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix(value ^ np.uint64(length * 0x1F123BB5)), at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column, nulls as empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(column: pa.Array, table: np.ndarray) -> Words:
    """Split texts into runs of bytes that ``table`` (256 entries) maps to non-zero; mapped bytes are hashed."""
    raw, offsets = buffers(column)
    mapped = table[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = mapped != 0
    edge = inside[1:] != inside[:-1]
    # a word ends where its text ends, though the next text goes on without a gap
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    touching = np.unique(borders[inside[borders] & inside[borders + 1]]) if len(borders) else borders
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    if len(touching):
        starts, ends = np.sort(np.concatenate([starts, touching])), np.sort(np.concatenate([ends, touching]))
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mapped.astype(np.uint64) * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * M2)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(hashes, doc, starts, ends, first, sums, down)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive words, one for each place it fits."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return mix(out)


def byte_table(keep, lower: bool = True) -> np.ndarray:
    """Map of bytes: those that ``keep`` accepts to themselves (A-Z to a-z), the others to 0 (gaps)."""
    out = np.zeros(256, np.uint8)
    for b in range(1, 256):
        if keep(b):
            out[b] = b + 32 if lower and 65 <= b <= 90 else b
    return out


#: Words between the ASCII white space bytes 0x20 and 0x09-0x0D. Byte 0 is a word byte there, so it maps to 1.
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
SPACED[0] = 1
#: Letters: ASCII letters and every byte of a non-ASCII character.
LETTERS = byte_table(lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122)
#: Letters and ASCII digits.
ALNUM = byte_table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
