"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

Texts are words of letters and digits, lower case; shingles are ``WIDTH`` words, weighted by
ln(1 + items / items that hold it). A window as long as an item, around any shingle that some item
has, gets a 64-bit SimHash of its weighted shingles, each counted once. Fingerprints are cut into four 16-bit blocks: two
that differ in at most RADIUS bits agree to RADIUS // 4 bits in one block, so a table of the items
near each block value finds every item within the radius, whichever shingles it has. What it finds is verified by the exact
weighted Jaccard similarity of the two shingle sets. (A window of similarity 0.8 shares most of the
item's shingles, so none that could pass is left out by fingerprinting only around shared ones.) Long texts
are taken SPAN words at a time, so what is held does not grow with a text's length or with how often a shingle recurs.

Items come in blocks of ``ITEM_BLOCK``, each a pass over the documents, so what is held and sent is
bounded whatever the benchmark's size.

Defined results: null and empty texts, and items or documents of fewer than WIDTH words, never match;
of several windows that match an item the most similar, then the first, is given; equal items each
match; repeated documents each match under their id. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship, slices
from .hashing import ALNUM, shingles, words

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 19
ITEM_BLOCK = 4096
#: Window starts that are fingerprinted together.
SPAN = 16384
FILTER_BITS = 20


@dataclass
class Screen:
    """The items of one pass: their shingles, weights and fingerprints."""

    ids: list[int]
    lengths: np.ndarray  # words of each item
    keys: np.ndarray  # sorted distinct shingles
    weights: np.ndarray  # of keys
    other: float  # weight of a shingle that no item has
    sets: list[np.ndarray]  # places in keys of each item's shingles
    prints: np.ndarray
    near: np.ndarray | None = field(default=None, repr=False)
    holders: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def __post_init__(self):
        self.ready = False

    def prepare(self) -> None:
        """Tables that are cheaper to make in the worker than to send."""
        if self.ready:
            return
        self.bloom = np.zeros(1 << FILTER_BITS, bool)
        self.bloom[self.keys & np.uint64((1 << FILTER_BITS) - 1)] = True
        values = np.arange(1 << 16, dtype=np.uint16)
        self.near = np.zeros((4, 1 << 16, -(-len(self.ids) // 8)), np.uint8)
        for block in range(4):
            part = (self.prints >> np.uint64(16 * block)).astype(np.uint16)
            for first in range(0, len(self.ids), 8):
                close = np.bitwise_count(values[:, None] ^ part[None, first : first + 8]) <= RADIUS // 4
                self.near[block, :, first // 8] = np.packbits(close, axis=1)[:, 0]
        owner = np.concatenate([np.full(len(s), i) for i, s in enumerate(self.sets)]) if self.sets else np.zeros(0, np.int64)
        key = np.concatenate(self.sets) if self.sets else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.holders = (np.searchsorted(key[order], np.arange(len(self.keys) + 1)), owner[order])
        self.ready = True

    def lookup(self, prints: np.ndarray, items: np.ndarray) -> np.ndarray:
        """(windows, items) true where the multi-index and then the whole fingerprint say within RADIUS."""
        found = np.zeros((len(prints), self.near.shape[2]), np.uint8)
        for block in range(4):
            found |= self.near[block][(prints >> np.uint64(16 * block)).astype(np.uint16)]
        listed = np.unpackbits(found, axis=1, count=len(self.ids))[:, items].astype(bool)
        return listed & (np.bitwise_count(prints[:, None] ^ self.prints[items][None]) <= RADIUS)

    def places(self, values: np.ndarray) -> np.ndarray:
        """Places of shingles in keys, -1 for those that no item has."""
        out = np.full(len(values), -1, np.int64)
        if not len(self.keys):
            return out
        likely = np.flatnonzero(self.bloom[values & np.uint64((1 << FILTER_BITS) - 1)])
        at = np.searchsorted(self.keys, values[likely])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == values[likely]
        out[likely[hit]] = at[hit]
        return out


def _signs(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.float32) * 2 - 1) * weights[:, None].astype(np.float32)


def _print(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def screen(items: list[tuple[int, str]], holders: dict[int, int] | None = None, total: int | None = None) -> Screen:
    """``holders``: how many items of the whole benchmark hold a shingle, if ``items`` are only some of ``total``."""
    column = pc.utf8_lower(pa.array([t or "" for _, t in items], pa.string()))
    found = words(column, ALNUM)
    ids, lengths, sets = [], [], []
    for n, (item, _) in enumerate(items):
        own = found.hashes[found.first[n] : found.first[n + 1]]
        if len(own) >= WIDTH:
            ids.append(item)
            lengths.append(len(own))
            sets.append(np.unique(shingles(own, WIDTH)))
    keys, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0))
    total = total or len(items)
    if holders is not None:
        count = np.array([holders.get(int(k), 1) for k in keys.view(np.int64)])
    weights = np.log1p(total / np.maximum(count, 1))
    places = [np.searchsorted(keys, s) for s in sets]
    sums = np.array([_signs(keys[p], weights[p]).sum(axis=0, dtype=np.float64) for p in places]) if sets else np.zeros((0, 64))
    return Screen(ids, np.array(lengths, np.int64), keys, weights, float(np.log1p(total)), places, _print(sums) if sets else np.zeros(0, np.uint64))


def _repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values seen before, and the place just before each of the same value."""
    order = np.argsort(values, kind="stable")
    again = np.flatnonzero(values[order][1:] == values[order][:-1])
    return order[again + 1], order[again]


def _match(own: np.ndarray, at: np.ndarray, screen: Screen, similarity: float) -> list[tuple[int, float, int]]:
    """(item place, similarity, first word) for one document's shingles ``own`` with places ``at`` in the item keys."""
    hits = np.flatnonzero(at >= 0)
    starts, owner = screen.holders
    held = [owner[starts[k] : starts[k + 1]] for k in np.unique(at[hits])]
    lengths = np.unique(screen.lengths[np.unique(np.concatenate(held))]).tolist()
    weight = np.where(at >= 0, screen.weights[at], screen.other)
    longest = lengths[-1] - WIDTH + 1
    best: dict[int, tuple[float, int]] = {}
    begin = max(0, int(hits[0]) - longest + 1)
    while begin <= hits[-1]:
        # the windows that begin here, and what they reach
        area = slice(begin, min(begin + SPAN + longest, len(own)))
        near = hits[(hits >= begin) & (hits < begin + SPAN + longest)]
        if len(near):
            _in_area(own[area], at[area], weight[area], near - begin, begin, len(own), lengths, screen, similarity, best)
        later = hits[hits >= begin + SPAN]
        begin = max(begin + SPAN, int(later[0]) - longest + 1) if len(later) else len(own)
    return [(item, value, a) for item, (value, a) in sorted(best.items())]


def _in_area(own, at, weight, hits, begin, total, lengths, screen, similarity, best) -> None:
    """Windows that begin in the first SPAN places of an area and hold a shared shingle; the best of each item goes to ``best``."""
    signs = _signs(own, weight)
    sums = np.zeros((len(own) + 1, 64), np.float64)
    np.cumsum(signs, axis=0, out=sums[1:])
    later, earlier = _repeats(own)
    for length in lengths:
        items = np.flatnonzero(screen.lengths == length)
        width = length - WIDTH + 1
        last = max(total - width, 0) - begin  # a document shorter than the item is one window
        cover = np.zeros(len(own) + 1, np.int64)
        np.add.at(cover, np.clip(hits - width + 1, 0, None), 1)
        np.subtract.at(cover, hits + 1, 1)
        first = np.flatnonzero(np.cumsum(cover) > 0)
        first = np.unique(np.minimum(first[first < SPAN], last))
        first = first[first >= 0]
        if not len(first):
            continue
        end = np.minimum(first + width, len(own))
        inside = sums[end] - sums[first]
        close = later - earlier < width
        if close.any():  # a shingle counts once in a window: not at a place whose earlier one is in it too
            twice = np.zeros_like(sums)
            np.add.at(twice, np.maximum(later[close] - width + 1, 0), signs[later[close]])
            np.subtract.at(twice, earlier[close] + 1, signs[later[close]])
            inside -= np.cumsum(twice, axis=0)[first]
        prints = _print(inside)
        windows, which = np.nonzero(screen.lookup(prints, items))
        for window, item in zip(windows.tolist(), items[which].tolist(), strict=True):
            a, b = int(first[window]), int(end[window])
            values, index = np.unique(own[a:b], return_index=True)
            places = at[a:b][index]
            shared = np.isin(places, screen.sets[item])
            common = float(screen.weights[places[shared]].sum())
            union = float(weight[a:b][index].sum()) + float(screen.weights[screen.sets[item]].sum()) - common
            value = common / union if union else 0.0
            if value >= similarity - 1e-12 and value > best.get(item, (0.0, 0))[0] + 1e-12:
                best[item] = (value, begin + a)


MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, item_block: int = ITEM_BLOCK) -> DataFrame:
    """A row for each document and item that it holds: similarity, and where the window begins and its words.

    ``docs``: doc_id long, text; ``benchmark``: item_id long, text.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.count()
    passes = max(1, -(-total // item_block))
    holders = _holders(items) if passes > 1 else None
    found = []
    for number in range(passes):
        some = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(passes)) == number).orderBy("item_id", "text").collect()
        one = screen([(r["item_id"], r["text"]) for r in some], _counts(holders, some), total)
        if one.ids:
            found.append(map_arrow(source, _worker(spark.sparkContext.broadcast(one), similarity), MATCHES))
    if not found:
        return spark.createDataFrame([], MATCHES)
    return reduce(DataFrame.unionByName, found)


def _holders(items: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            found = words(pc.utf8_lower(batch.column("text")), ALNUM)
            for n in range(batch.num_rows):
                own = np.unique(shingles(found.hashes[found.first[n] : found.first[n + 1]], WIDTH))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["shingle"])

    return map_arrow(items.select("text"), work, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")


def _counts(holders: DataFrame | None, some: list) -> dict[int, int] | None:
    """Of the shingles of a pass's items, how many items hold them; those of one item are left out."""
    if holders is None:
        return None
    spark = holders.sparkSession
    found = words(pc.utf8_lower(pa.array([r["text"] for r in some], pa.string())), ALNUM)
    own = np.unique(np.concatenate([shingles(found.hashes[a:b], WIDTH) for a, b in zip(found.first, found.first[1:], strict=False)] or [np.zeros(0, np.uint64)]))
    wanted = spark.createDataFrame(pa.table({"shingle": own.view(np.int64)}))
    return {r["shingle"]: r["n"] for r in holders.join(wanted, "shingle", "left_semi").collect()}


def _worker(shared, similarity: float):
    def work(batches):
        one: Screen = shared.value
        one.prepare()
        for batch in batches:
            rows = []
            for part in slices(batch, "text"):
                found = words(pc.utf8_lower(part.column("text")), ALNUM)
                values = shingles(found.hashes, WIDTH)
                at = one.places(values)
                hits = np.flatnonzero(at >= 0)
                hits = hits[found.doc[hits] == found.doc[hits + WIDTH - 1]]
                keys = part.column("doc_id")
                for doc in np.unique(found.doc[hits]).tolist():
                    a, b = int(found.first[doc]), int(found.first[doc + 1]) - WIDTH + 1
                    for item, value, first in _match(values[a:b], at[a:b], one, similarity):
                        n = min(int(one.lengths[item]), b - a + WIDTH - 1)
                        rows.append({"doc_id": keys[doc].as_py(), "item_id": one.ids[item], "similarity": value, "first_word": first, "n_words": n})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    return work
