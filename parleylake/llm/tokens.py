"""Token ids of documents, written as wavelet-matrix shards in ascending id order and read back.

Documents are range-partitioned by id, encoded in their partition and written as one shard file for
about every ``shard_tokens`` ids, through a temporary name that is renamed when complete, so that a
task run twice leaves one good file. The manifest (a row for each shard, and the first place of
each) is all that the reader needs.

Defined results: a null or empty text gives the end id alone; repeated ids are documents of their own,
next to one another; a null id sorts first. An empty table gives no shard and no rows. A shard has as many
planes as the vocabulary's ids need, and an id beyond them is an error, never cut.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wavelet
from .common import Scratch, map_arrow, slices
from .hashing import M1, M2, buffers, mix, spans

SHARD_TOKENS = 4_000_000
END = 1
#: Slots of a worker's table of known pieces; it starts afresh when half of them are taken.
SLOT_BITS = 20

# The settings under which a text's ids are those of its pieces in order.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Kinds of bytes. Chunks between blanks that have only letters, digits and marks fall into runs of one kind.
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
_TOP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _kinds(special: str) -> np.ndarray:
    """Kind of each byte by itself; bytes of special tokens, the apostrophe and non-ASCII ones are OTHER."""
    out = np.full(256, OTHER, np.uint8)
    for byte in range(33, 127):
        char = chr(byte)
        out[byte] = LETTER if char.isalpha() else DIGIT if char.isdigit() else MARK
        if out[byte] == MARK and (char == "'" or char in special):
            out[byte] = OTHER
    out[[9, 10, 13, 32]] = BLANK
    return out


class Pieces:
    """Places of 128-bit keys: open addressing over arrays, so that whole batches are looked up at once."""

    def __init__(self, bits: int = SLOT_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros((2, 1 << bits - 1), np.uint64)
        self.count = 0

    def room(self, more: int) -> bool:
        return self.count + more <= self.keys.shape[1]

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is new."""
        out = np.full(len(one), -1, np.int32)
        todo, slot = np.arange(len(one)), one & self.mask
        while len(todo):
            at = self.slots[slot]
            same = (at >= 0) & (self.keys[0][at] == one[todo]) & (self.keys[1][at] == two[todo])
            out[todo[same]] = at[same]
            on = (at >= 0) & ~same
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Number distinct new keys onwards."""
        places = np.arange(self.count, self.count + len(one), dtype=np.int32)
        self.keys[0][places], self.keys[1][places] = one, two
        self.count += len(one)
        slot = one & self.mask
        while len(places):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = places[free]
            left = self.slots[slot] != places
            places, slot = places[left], (slot[left] + np.uint64(1)) & self.mask


class Encoder:
    """Encodes whole texts through the tokenizers library; equal pieces are encoded once.

    Under the settings above, blanks separate, and a chunk of ASCII or Latin-1 letters, digits and marks falls
    into runs of one kind; any other chunk is one piece. A piece is known by 128 bits of hashes of its bytes (itself, up
    to 8 bytes). With other settings every text goes through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        spec = json.loads(self.tokenizer.to_str())
        added = spec.get("added_tokens") or []
        self.local = self._local(spec, added)
        self.kinds = _kinds("".join(a["content"] for a in added))
        self.bits = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, END).bit_length()
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        self.reset()

    @staticmethod
    def _local(spec: dict, added: list[dict]) -> bool:
        normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        plain = all(any(not c.isalnum() and c.isascii() for c in a["content"]) and not any(c in " \t\n\r" for c in a["content"]) for a in added)
        return (
            [n.get("type") for n in normalizers] == NORMALIZERS
            and normalizers[1].get("pattern") == {"Regex": r"\s+"} and normalizers[1].get("content") == " "
            and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
            and plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        )

    def reset(self) -> None:
        self.known = Pieces()
        # of piece i, ids are flat[begin[i]:begin[i] + size[i]]; place 0 is END, which is no text's
        self.flat, self.used = np.zeros(1 << 20, self.dtype), 1
        self.flat[0] = END
        room = self.known.keys.shape[1]
        self.begin, self.size = np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.known.add(np.zeros(1, np.uint64), np.zeros(1, np.uint64))
        self.size[0] = 1

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, ids: list[int], sizes: list[int], first: int) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        size = np.array(sizes, np.int32)
        own = slice(first, first + len(size))
        self.size[own], self.begin[own] = size, self.used + np.cumsum(size) - size
        self.used += len(ids)

    def _learn(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Ids of new pieces. Runs of one kind go to the library many at a time and come apart by offsets."""
        order = np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)])
        first, runs = self.known.count, int((~whole).sum())
        self.known.add(one[order], two[order])
        text = memoryview(raw)
        names = [str(text[a:b], "utf-8") for a, b in zip(begin[order].tolist(), end[order].tolist(), strict=True)]
        for start in range(0, runs, 4000):
            some = names[start : min(start + 4000, runs)]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            edges = np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids)), ends)
            self._keep(found.ids, np.diff(edges, prepend=0), first + start)
        if runs < len(names):
            lists = [self._library(name) for name in names[runs:]]
            self._keep([i for ids in lists for i in ids], list(map(len, lists)), first + runs)

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces' first and past-last bytes, which of them are whole chunks, and the bytes, letters in lower case but for those."""
        kind = self.kinds[raw]
        lower = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
        lead = np.flatnonzero(raw == 0xC3)  # Latin-1 letters
        after = raw[lead + 1]
        letter = (after != 0x97) & (after != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
        upper = lead[letter & (after <= 0x9E)] + 1
        lower[upper] += 32
        if (kind == OTHER).any():
            border = np.zeros(len(raw) + 1, bool)
            border[offsets] = True
            inside = kind != BLANK
            starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate([[False], inside[:-1]])))
            ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
            odd = np.unique(np.searchsorted(starts, np.flatnonzero(kind == OTHER), side="right") - 1)
            places, _ = spans(starts[odd], ends[odd])
            kind[places], lower[places] = OTHER, raw[places]
        change = np.ones(len(raw) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[offsets] = True
        inside = kind != BLANK
        begin, end = np.flatnonzero(change[:-1] & inside), np.flatnonzero(change[1:] & inside) + 1
        return begin, end, kind[begin] == OTHER, lower

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, an END after each; and how many each has."""
        if not self.local:
            lists = [[*self._library(t or ""), END] for t in column.to_pylist()]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        raw, offsets = buffers(column)
        begin, end, whole, lower = self._cut(raw, offsets)
        one, two = _keys(lower, begin, end, whole)
        at = self.known.find(one, two)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            order = fresh[np.lexsort((two[fresh], one[fresh]))]
            differs = np.ones(len(order), bool)
            differs[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
            new = order[differs]
            if not self.known.room(len(new)):
                self.reset()
                return self.encode(column) if self.known.room(len(new)) else self._halves(column)
            self._learn(lower, begin[new], end[new], whole[new], one[new], two[new])
            at[fresh] = self.known.find(one[fresh], two[fresh])
        first = np.searchsorted(begin, offsets[1:])  # an END stands before each next text's pieces
        at = np.insert(at, first, 0)
        size = self.size[at]
        total = np.cumsum(size, dtype=np.int64)
        source = np.repeat(self.begin[at] - (total - size), size)
        source += np.arange(len(source))
        return self.flat[source], np.diff(total[first + np.arange(len(first))], prepend=0)

    def _halves(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A batch with more different pieces than the table has room for."""
        middle = len(column) // 2
        if not middle:
            ids = [*self._library(column[0].as_py()), END]
            return np.array(ids, self.dtype), np.array([len(ids)], np.int64)
        parts = [self.encode(column.slice(0, middle)), self.encode(column.slice(middle))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _keys(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a piece: its bytes by eights through two hashes, with its length and whether it is a whole chunk."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[: len(raw)], (len(raw), 8), (1, 1)) if len(raw) else np.zeros((0, 8), np.uint8)
    size = end - begin
    one = size.astype(np.uint64) * np.uint64(2) + whole + np.uint64(1)
    two = one.copy()
    todo = np.arange(len(begin))
    step = 0
    while len(todo):
        left = size[todo] - step
        value = np.ascontiguousarray(eights[begin[todo] + step]).view("<u8").reshape(-1) & _TOP[np.minimum(left, 8)]
        one[todo] = mix(one[todo] * M1 + value)
        two[todo] = (two[todo] ^ value) * M2 + (value >> np.uint64(29))
        step += 8
        todo = todo[left > 8]
    return one, two


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _write(folder: str, name: str, raw: bytes) -> str:
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft, final = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
    with store.open_output_stream(draft) as out:
        out.write(raw)
    store.move(draft, final)
    return f"{folder}/{name}"


MANIFEST = "shard string, part int, nth int, docs long, tokens long, bytes long, first_doc long"


def write(docs: DataFrame, tokenizer: str, folder: str, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Write shards of (doc_id long, text) into ``folder`` (a URI all executors see); the manifest, lazily."""
    spark = docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())

    def work(batches):
        known = encoder(tokenizer)
        ids, counts, keys, held, nth, part = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, counts, keys, held, nth
            all_ids, all_counts = np.concatenate(ids), np.concatenate(counts)
            doc_ids = np.array(keys, np.int64)
            raw = wavelet.encode(all_ids, doc_ids, all_counts, known.bits)
            uri = _write(folder, f"part-{part:06d}-{nth:04d}.wvm", raw)
            row = pa.RecordBatch.from_pylist([{"shard": uri, "part": part, "nth": nth, "docs": len(keys), "tokens": len(all_ids), "bytes": len(raw), "first_doc": keys[0]}], pa.schema([("shard", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("first_doc", pa.int64())]))
            ids, counts, keys, held, nth = [], [], [], 0, nth + 1
            return row

        for batch in batches:
            for piece in slices(batch, "text"):
                part = piece.column("part")[0].as_py()
                some, lengths = known.encode(piece.column("text"))
                ids.append(some)
                counts.append(lengths)
                keys += piece.column("doc_id").fill_null(np.iinfo(np.int64).min).to_pylist()
                held += len(some)
                if held >= shard_tokens:
                    yield flush()
        if keys:
            yield flush()

    return map_arrow(ordered, work, MANIFEST)


READ = "shard string, shard_start long, nth_doc long, doc_id long, start long, n_tokens long, ids_crc32 long"


def read_back(manifest: DataFrame) -> DataFrame:
    """A row for each document, from the shard files alone: where it starts in all tokens, its tokens and their checksum.

    The window runs over the manifest, a row for each shard of millions of tokens.
    """
    placed = manifest.withColumn("shard_start", F.sum("tokens").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)))
    shards = placed.select("shard", F.coalesce("shard_start", F.lit(0).cast("long")).alias("shard_start"))
    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def work(batches):
        for batch in batches:
            for uri, base in zip(batch.column("shard").to_pylist(), batch.column("shard_start").to_pylist(), strict=True):
                shard = wavelet.Shard.open(uri)
                ids = shard.decode().astype("<u4")
                view = memoryview(ids.tobytes())
                edges = shard.starts.tolist()
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
                n = len(crc)
                doc_ids = pa.array(shard.doc_ids, mask=shard.doc_ids == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(np.full(n, base, np.int64)), pa.array(np.arange(n)), doc_ids, pa.array(shard.starts[:-1] + base), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=[c.split()[0] for c in READ.split(", ")])

    return map_arrow(shards.repartition(tasks, "shard"), work, READ)


def round_trip(docs: DataFrame, scratch: Scratch, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(manifest, documents read back)."""
    folder = scratch.path("shards")
    manifest = scratch.table(write(docs, tokenizer, folder if "://" in folder else f"file://{folder}", shard_tokens), "manifest")
    return manifest, read_back(manifest)
