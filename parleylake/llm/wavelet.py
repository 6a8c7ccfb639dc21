"""Token ids in one compressed file a shard: a wavelet matrix with rank and select.

A shard holds the ids of a run of documents in ascending id order, as bit-planes from the highest bit
down; each plane is stably partitioned by its bits (zeros first) to give the order of the next. The
planes are stored in blocks of ``BLOCK_BITS`` bits, each block deflated on its own (zstd) beside the
count of ones before it, so access, rank and select read a block or two of each plane; inside a block
that was read, counts by 64-bit word answer them. A shard is read from bytes or, by ranges, from a file.

File: magic, then a JSON header (lengths, offsets and rank counts of the blocks, zeros of each plane),
the document table (ids, token counts) and the blocks.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs

MAGIC = b"PLWM\x01\0\0\0"
BLOCK_BITS = 1 << 17
_codec = pa.Codec("zstd", compression_level=1)


def _pack(raw: bytes) -> bytes:
    return _codec.compress(raw, asbytes=True)


def _unpack(raw: bytes, size: int) -> bytes:
    return _codec.decompress(raw, decompressed_size=size, asbytes=True)


def encode(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, bits: int = 16) -> bytes:
    """The shard file of the documents' ids, laid end to end."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError("id beyond the planes")
    ids = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
    n, planes, body, at = len(ids), [], [], 0
    current = ids
    for level in range(bits):
        ones = ((current >> current.dtype.type(bits - 1 - level)) & current.dtype.type(1)).astype(bool)
        offsets, ranks, rank = [], [], 0
        packed = np.packbits(ones)
        for start in range(0, n, BLOCK_BITS):
            block = _pack(packed[start // 8 : (start + BLOCK_BITS) // 8].tobytes())
            offsets.append(at)
            ranks.append(rank)
            rank += int(np.count_nonzero(ones[start : start + BLOCK_BITS]))
            body.append(block)
            at += len(block)
        planes.append({"zeros": n - rank, "offsets": offsets, "ranks": ranks})
        current = np.concatenate([np.compress(~ones, current), np.compress(ones, current)])
    documents = _pack(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(counts, "<i8").tobytes())
    header = _pack(json.dumps({"planes": planes}, separators=(",", ":")).encode())
    size = len(json.dumps({"planes": planes}, separators=(",", ":")).encode())
    head = MAGIC + struct.pack("<IQQIIII", bits, n, at, len(doc_ids), len(documents), len(header), size)
    return head + header + documents + b"".join(body)


_HEAD = struct.Struct("<IQQIIII")


class Shard:
    """A reader over one shard: its bytes, or an open file of which only what is asked for is read."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = source
        size = len(source) if isinstance(source, bytes) else source.size()
        at = len(MAGIC) + _HEAD.size
        start = self._bytes(0, at)
        if len(start) < at or start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.bits, self.n, self.body_size, self.docs, doc_size, head_size, json_size = _HEAD.unpack_from(start, len(MAGIC))
        self.at = at + head_size + doc_size
        if size != self.at + self.body_size:
            raise ValueError("cut wavelet shard")
        self.planes = json.loads(_unpack(self._bytes(at, head_size), json_size))["planes"]
        table = np.frombuffer(_unpack(self._bytes(at + head_size, doc_size), 16 * self.docs), "<i8") if self.docs else np.zeros(0, "<i8")
        self.doc_ids, self.counts = table[: self.docs], table[self.docs :]
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self._words = lru_cache(maxsize=64)(self._counted)

    @staticmethod
    def open(uri: str) -> Shard:
        store, path = arrow_fs.FileSystem.from_uri(uri)
        return Shard(store.open_input_file(path))

    def _bytes(self, at: int, size: int) -> bytes:
        return self.source[at : at + size] if isinstance(self.source, bytes) else self.source.read_at(size, at)

    def _load(self, level: int, block: int) -> np.ndarray:
        """The packed bits of a block."""
        offsets = self.planes[level]["offsets"]
        start = offsets[block]
        following = offsets[block + 1] if block + 1 < len(offsets) else (self.planes[level + 1]["offsets"][0] if level + 1 < self.bits else self.body_size)
        length = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        return np.frombuffer(_unpack(self._bytes(self.at + start, following - start), -(-length // 8)), np.uint8)

    def _counted(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block as 64-bit words, the first bit highest, and the ones before each word."""
        packed = self._load(level, block)
        words = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(">u8").astype(np.uint64)
        return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def _rank1(self, level: int, place: int) -> int:
        """Ones of a plane before ``place``."""
        block, rest = divmod(place, BLOCK_BITS)
        ranks = self.planes[level]["ranks"]
        if block == len(ranks):
            return self.n - self.planes[level]["zeros"]
        if not rest:
            return ranks[block]
        words, before = self._words(level, block)
        word, bit = divmod(rest, 64)
        return ranks[block] + int(before[word]) + ((int(words[word]) >> (64 - bit)).bit_count() if bit else 0)

    def _bit(self, level: int, place: int) -> int:
        block, rest = divmod(place, BLOCK_BITS)
        return int(self._words(level, block)[0][rest // 64]) >> (63 - rest % 64) & 1

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, place)
            ones = self._rank1(level, place)
            value = value << 1 | bit
            place = self.planes[level]["zeros"] + ones if bit else place - ones
        return value

    def _range(self, token: int, place: int) -> tuple[int, int]:
        start = 0
        for level in range(self.bits):
            zeros = self.planes[level]["zeros"]
            a, b = self._rank1(level, start), self._rank1(level, place)
            start, place = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (start - a, place - b)
        return start, place

    def count(self, token: int, place: int | None = None) -> int:
        """Occurrences of an id before a place (rank); of the whole shard without one."""
        if token < 0 or token >> self.bits:
            return 0
        start, end = self._range(token, self.n if place is None else min(max(place, 0), self.n))
        return end - start

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) equal bit of a plane."""
        ranks = self.planes[level]["ranks"]
        before = ranks if bit else [i * BLOCK_BITS - r for i, r in enumerate(ranks)]
        block = int(np.searchsorted(before, nth, side="right")) - 1
        words, ones = self._words(level, block)
        counts = ones if bit else np.arange(len(ones)) * 64 - ones
        rest = nth - before[block]
        word = int(np.searchsorted(counts, rest, side="right")) - 1
        held = int(words[word]) if bit else ~int(words[word])
        inside = [k for k in range(64) if held >> (63 - k) & 1][rest - int(counts[word])]
        return block * BLOCK_BITS + word * 64 + inside

    def locate(self, token: int, nth: int) -> int:
        """Place of an id's nth occurrence (from 0): select."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        place = self._range(token, self.n)[0] + nth
        for level in range(self.bits - 1, -1, -1):
            zeros = self.planes[level]["zeros"]
            place = self._select(level, 1, place - zeros) if token >> (self.bits - 1 - level) & 1 else self._select(level, 0, place)
        return place

    def decode(self) -> np.ndarray:
        """All ids in order, planes undone from the last."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            blocks = [self._load(level, b) for b in range(len(self.planes[level]["offsets"]))]
            ones = np.unpackbits(np.concatenate([np.zeros(0, np.uint8), *blocks]), count=self.n).view(bool)
            zeros = self.planes[level]["zeros"]
            before = np.empty_like(values)
            before[~ones] = values[:zeros]
            before[ones] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - level))
            values = before
        return values
