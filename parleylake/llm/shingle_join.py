"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles. Equal sets are one class from the start. Sets of Jaccard similarity
t or more differ in at most d shingles, d from their sizes, so of more than d parts of the hash space some
hold the same shingles of both: classes meet in groups of one equal part. Parts are cut by size range
(see ``Parts``), need no counts over the corpus, and hold a shingle at least, so a group has sets that share all of a part,
whatever the size of the corpus. Sets with too many empty parts post a second cut besides, and those that have them there too the
first of their shingles by hash, as a prefix filter asks; an empty part is never posted.

Inside a group a signature tree is joined with itself: nodes hold the OR of their members' token bitmaps, their range
of set sizes, and the range of their components; the dual traversal drops a pair of nodes whose largest
possible overlap is less than what their smallest sizes need, or whose members are linked already.
What is left is verified on the whole sets of 64-bit hashes. All groups of a run of rows are one forest, traversed level by level.
A pair comes out of the first of the groups it meets in. A first traversal gives the likeliest pairs of two components only, in each group;
they link most. Groups where it held others back, and spread ones, are traversed again with the components of then, for all that is not linked.

Groups are range-partitioned by (part, component, size), so one of any size is spread over tasks as
subtrees of at most ``NODE`` members, and the roots of a spread group are joined pair by pair after the same
pruning. Cheap chains along each group link most copies before that; linked members are never paired
again, so a large group of near copies costs a few pairs a member, not all pairs. No link is lost:
every pair that shares a group and is not linked by then is bounded or verified.

Defined results: texts without a word have an empty set, link with nothing and are their own
component; a text of fewer words than a shingle has its whole sequence as one; rows of a null id get
a null component. Rows that repeat an id are one document: each has its own set, and they share a component with
all that any of them links with.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import erfc, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_filter, map_arrow, passes, ship, slices
from .components import components
from .hashing import M2, SPACED, mix, shingles, spans, words

#: Bits of a group's key. Parts that collide only add candidates.
KEY_BITS = 48
#: The fewest shingles that count for a part, where the sizes allow it; and the share of sets that may have too few such parts.
FULL, WEAK = 4, 0.03
#: Bits of a class's token bitmap; a smaller one leaves many more pairs below the threshold.
BITMAP = 2048
NODE = 1024
FANOUT = 8
#: Steps of the chains along a group, and the groups of a member that chains run along.
CHAIN, HOMES = (1, 2, 4), 6
#: The smallest keys of a member's groups, which tell where a pair has met before. Beyond them a pair may come out more than once, never less.
FIRST = 16
#: Pairs of two components that a group gives at first.
LIKELIEST = 4
#: Pairs of members whose trees are traversed at a time.
TOGETHER = 1 << 22


def sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = words(column, SPACED)
    values = shingles(found.hashes, width)
    out = []
    for a, b in zip(found.first.tolist(), found.first[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(values[a : b - width + 1]))
        elif b > a:
            out.append(shingles(np.concatenate([found.hashes[a:b], np.full(1, (b - a) * int(M2) % (1 << 64), np.uint64)]), b - a + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=None)
def size_ranges(percent: int, most: int) -> tuple[int, ...]:
    """Borders of the size ranges up to a size of ``most``: sets that link are in one range or in two beside each other."""
    least = 1
    while least * 100 < (least + 1) * percent:
        least += 1
    out = [least]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return tuple(out)


@dataclass(frozen=True)
class Parts:
    """How the hash space is cut for pairs whose smaller set is of one size range.

    The sets of such a pair differ in at most ``differ`` shingles, so of ``count`` parts at least
    ``count - differ`` are equal in both. A set with at most ``spare = count - differ - 1`` parts of fewer than ``full`` shingles
    has one of the others among them, so it meets any set that it links with under a full part. A weak set, with more of those,
    meets at least the sets that are not weak, which post their full parts, as it does; weak ones meet by a second cut.
    """

    count: int
    spare: int
    full: int
    largest: int

    @staticmethod
    @lru_cache(maxsize=None)
    def of(low: int, high: int, percent: int) -> Parts:
        """For a smaller set of ``low`` to ``high`` shingles."""
        largest = high * 100 // percent
        differ = (100 - percent) * (high + largest) // (100 + percent)

        def weak(count: int, full: int) -> float:
            """The share of sets of ``low`` shingles with too many parts of fewer than ``full``."""
            each, spare = low / count, count - differ - 1
            mean = count * sum(exp(-each) * each**k / factorial(k) for k in range(full))
            if mean > 30:
                return 0.5 * erfc((spare + 0.5 - mean) / sqrt(2 * mean))
            term = total = exp(-mean)
            for k in range(1, min(spare, 200) + 1):
                term *= mean / k
                total += term
            return 1.0 - total

        step = 1 + differ // 50
        most = differ + 3 + (differ + 1) // 3
        for full in range(FULL, 0, -1):
            for count in range(differ + 1, differ + 3 + (differ + 1) // 6 if full > 1 else most, step):
                if weak(count, full) <= WEAK:
                    return Parts(count, count - differ - 1, full, largest)
        count = min(range(differ + 1, most, step), key=lambda c: weak(c, 1))
        return Parts(count, count - differ - 1, 1, largest)

    def keys(self, own: np.ndarray, sums: np.ndarray, name: int) -> tuple[np.ndarray, bool]:
        """Keys of a sorted set's full parts, and whether it is weak; ``sums`` are the running sums of its mixed hashes, from 0."""
        step = (1 << 64) // self.count
        edges = np.searchsorted(own, np.arange(1, self.count, dtype=np.uint64) * np.uint64(step))
        edges = np.concatenate([[0], edges, [len(own)]])
        part = np.arange(self.count, dtype=np.uint64)
        keys = mix((sums[edges[1:]] - sums[edges[:-1]]) ^ mix(part + np.uint64(name << 32)))
        some = np.diff(edges) >= self.full
        return keys[some], self.count - int(some.sum()) > self.spare


def part_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the groups that a sorted set of shingle hashes belongs to."""
    n = len(own)
    borders = size_ranges(percent, 1 << n.bit_length())
    at = bisect_right(borders, n) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own), dtype=np.uint64)])
    out, again = [np.zeros(0, np.uint64)], None
    for k in range(max(at - 1, 0), at + 1):  # as the larger set of a pair, and as the smaller
        parts = Parts.of(borders[k], borders[k + 1] - 1, percent)
        if n > parts.largest:
            continue
        keys, weak = parts.keys(own, sums, 2 * k)
        out.append(keys)
        if weak:
            if again is None:  # the same set by other hashes
                other = np.sort(mix(own ^ M2))
                again = other, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(other), dtype=np.uint64)])
            keys, weak = parts.keys(*again, 2 * k + 1)
            out.append(keys)
        if weak:
            out.append(mix(own[: n - -(-n * percent // 100) + 1] ^ np.uint64((k << 32) + 1)))
    return (np.concatenate(out) >> np.uint64(64 - KEY_BITS)).view(np.int64)


DESCRIBED = "doc_id long, n_shingles long, d1 long, d2 long, parts array<long>, bitmap binary"


def _describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    def one(own: np.ndarray) -> tuple:
        n = len(own)
        if not n:
            return 0, 0, 0, [], b""
        d1, d2 = int(mix(own).sum(dtype=np.uint64).astype(np.int64)), int(mix(own ^ M2).sum(dtype=np.uint64).astype(np.int64))
        if n * 100 < (n + 1) * percent:  # so small that it links with equal sets only
            return n, d1, d2, [], b""
        bits = np.zeros(BITMAP, np.uint8)
        bits[own & np.uint64(BITMAP - 1)] = 1
        return n, d1, d2, part_keys(own, percent), np.packbits(bits).tobytes()

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n, d1, d2, parts, bitmap = zip(*map(one, sets(part.column("text"), width)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(bitmap, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "parts", "bitmap"])

    return map_arrow(docs, work, DESCRIBED)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Edges of runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _whole_runs(batches, column: str):
    """Sorted batches cut at the borders of runs, so that no run is split, but for those longer than a batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = held[column].to_numpy()
        border = int(_runs(keys)[-2])
        if border == 0 and held.num_rows < 50_000:
            continue
        cut = border or held.num_rows
        yield held.slice(0, cut)
        held = held.slice(cut) if cut < held.num_rows else None
    if held is not None and held.num_rows:
        yield held


def _shared_groups(described: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """(key, rep, n) where classes share a part; a task keeps its first and last key, which may go on beside it.

    Postings are of all documents, as they were written; which of them stand for a class is asked of the shared ones only.
    """
    postings = described.where("doc_id is not null").select(F.explode("parts").alias("key"), F.col("doc_id").alias("rep"))
    ordered = postings.repartitionByRange(tasks, "key", "rep").sortWithinPartitions("key", "rep")

    def work(batches):
        first, tail, shared_tail = True, None, False
        for table in _whole_runs(batches, "key"):
            keys = table["key"].to_numpy()
            goes_on = tail is not None and tail["key"][0].as_py() == keys[0]  # a run longer than a table
            if tail is not None and (shared_tail or goes_on):
                yield from tail.to_batches()
            size = np.diff(_runs(keys))
            kept = size > 1
            kept[0] |= first or goes_on
            first = False
            tail, shared_tail = table.slice(table.num_rows - int(size[-1])), bool(kept[-1])
            yield from table.slice(0, table.num_rows - int(size[-1])).filter(pa.array(np.repeat(kept[:-1], size[:-1]))).to_batches()
        if tail is not None:
            yield from tail.to_batches()

    return map_arrow(ordered, work, "key long, rep long").join(classes.select("rep", F.col("n_shingles").alias("n")).distinct(), "rep").select("key", "rep", "n")


PAIRS = "a long, b long"


def _different(groups: DataFrame) -> DataFrame:
    """Of groups of the same members one; those of a single member go."""
    one, two = F.bit_xor(F.xxhash64("rep", "n")).alias("h1"), F.bit_xor(F.xxhash64("n", F.lit(1), "rep")).alias("h2")
    members = groups.groupBy("key").agg(one, two, F.count("*").alias("k")).where("k > 1")
    return groups.join(members.groupBy("h1", "h2", "k").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _fits(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent


def _homes(groups: DataFrame) -> DataFrame:
    """(rep, n, homes): the smallest keys of each member's groups, in order."""
    return groups.groupBy("rep", "n").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST).alias("homes"))


def _chains(homes: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs near each other along the groups, a few a member: cheap links, not all of them."""
    # near copies share most groups, and so those of their smallest keys
    some = homes.select(F.explode(F.slice("homes", 1, HOMES)).alias("key"), "rep", "n")
    ordered = some.repartitionByRange(tasks, "key", "n", "rep").sortWithinPartitions("key", "n", "rep")

    def work(batches):
        seen = np.zeros((0, 2), np.int64)
        for table in _whole_runs(batches, "key"):
            keys, rep, n = (table[c].to_numpy() for c in ("key", "rep", "n"))
            edges = _runs(keys)
            head = np.repeat(edges[:-1], np.diff(edges))
            places = np.arange(len(keys))
            found = [np.stack([head, places], axis=1)] + [np.stack([places - step, places], axis=1)[places - step >= head] for step in CHAIN]
            left, right = np.concatenate(found).T
            good = (rep[left] != rep[right]) & _fits(n[left], n[right], percent)
            pairs = np.sort(np.stack([rep[left[good]], rep[right[good]]], axis=1), axis=1)
            pairs = np.unique(pairs, axis=0)
            if len(seen):  # the same copies meet under many parts
                both, first = np.unique(np.concatenate([seen, pairs]), axis=0, return_index=True)
                pairs = both[first >= len(seen)]
            seen = np.concatenate([seen, pairs])[-200_000:]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return map_arrow(ordered, work, PAIRS).distinct()


def _wanted_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rep, n, shingles): whole sets of the texts whose ids pass a filter of ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, lambda t: t["id"].to_numpy(), ["id"]))

    def work(batches):
        table = shared.value
        for batch in batches:
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            wanted = batch.filter(pa.array(passes(table, keys)))
            for part in slices(wanted, "text") if wanted.num_rows else ():
                own = sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["rep", "n", "shingles"])

    return map_arrow(docs.where("doc_id is not null"), work, "rep long, n long, shingles binary")


def _overlap_bound(bits1: np.ndarray, n1: np.ndarray, bits2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The most shingles that two sets can share: what has no bit in the other is not shared."""
    return np.minimum(n1 - np.bitwise_count(bits1 & ~bits2).sum(axis=1), n2 - np.bitwise_count(bits2 & ~bits1).sum(axis=1))


def _possible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the whole bitmaps leave."""
    one = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("bitmap").alias("ba"))
    two = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("bitmap").alias("bb"))

    def work(batches):
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITMAP // 64) for c in ("ba", "bb")]
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            keep = _overlap_bound(bits[0], na, bits[1], nb) * (100 + percent) >= percent * (na + nb)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb"), work, PAIRS)


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    pairs = scratch.table(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    whole = scratch.table(_wanted_sets(docs, ids.distinct(), width), "sets")
    left = whole.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = whole.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")

    def work(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(common * 100 >= percent * (len(both) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    return map_arrow(joined.select("a", "b", "sa", "sb"), work, PAIRS).distinct()


class Forest:
    """Signature trees of groups over members sorted by (component, size): OR bitmaps, and ranges of sizes and components, by level.

    ``edges`` are where the groups begin and the last one ends. Every group has a root on the top level.
    ``key`` names each member's group, ``homes`` has the first keys of its groups by rows; without them a pair may have met before.
    """

    def __init__(self, rep: np.ndarray, n: np.ndarray, component: np.ndarray, bitmap: np.ndarray, edges: np.ndarray, key: np.ndarray | None = None, homes: np.ndarray | None = None):
        self.rep, self.key, self.homes, self.roots = rep, key, homes, np.arange(len(edges) - 1)
        excess = n - np.bitwise_count(bitmap).sum(axis=1).astype(np.int64)
        self.levels = [(bitmap, n, n, component, component, excess)]
        self.children: list[np.ndarray] = []  # of each level but the lowest: where the nodes' children begin, and end
        size = np.diff(edges)
        while (size > 1).any():
            above = -(-size // FANOUT)
            first, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), above)
            cuts = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(above) - above, above)) * FANOUT
            bits, low, high, one, two, over = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(one, cuts), np.maximum.reduceat(two, cuts), np.maximum.reduceat(over, cuts)))
            self.children.append(np.append(cuts, len(bits)))
            size = above

    def joined(self, percent: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of members under pairs of roots x, y that may reach the threshold, are of different components, and have not met before."""
        for level in range(len(self.levels) - 1, -1, -1):
            keep = self._possible(self.levels[level], x, y, percent)
            x, y = x[keep], y[keep]
            if level:
                begin = self.children[level - 1]
                width = begin[y + 1] - begin[y]
                inner, owner = spans(begin[x], begin[x + 1])
                each = width[owner]
                y, _ = spans(begin[y][owner], begin[y][owner] + each)
                x = np.repeat(inner, each)
                ordered = x <= y  # a node with itself gives each pair of children once
                x, y = x[ordered], y[ordered]
        if self.homes is None:
            return x, y
        fresh = self._fresh(x, y)
        return x[fresh], y[fresh]

    def _fresh(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs have no earlier group in common, as far as their first keys tell."""
        out = np.ones(len(x), bool)
        for start in range(0, len(x), 8192):
            a, b = x[start : start + 8192], y[start : start + 8192]
            one, two = self.homes[a], self.homes[b]
            common = (one[:, :, None] == two[:, None, :]).any(axis=2) & (one < self.key[a][:, None])
            out[start : start + 8192] = ~common.any(axis=1)
        return out

    def likeliest(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs are among the LIKELIEST of their components and group by the bound of their similarity."""
        bits, n, _, component, _, over = self.levels[0]
        shared = np.zeros(len(x), np.int64)
        for start in range(0, len(x), 8192):
            a, b = x[start : start + 8192], y[start : start + 8192]
            shared[start : start + 8192] = np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64) + np.minimum(over[a], over[b])
        one, two = np.minimum(component[x], component[y]), np.maximum(component[x], component[y])
        order = np.lexsort((-shared / np.maximum(n[x] + n[y], 1), two, one, self.key[x]))
        same = np.zeros(len(x), bool)
        same[1:] = np.logical_and.reduce([v[order][1:] == v[order][:-1] for v in (self.key[x], one, two)])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
        out = np.zeros(len(x), bool)
        out[order] = np.arange(len(x)) - head < LIKELIEST
        return out

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """``joined`` of each tree with itself."""
        return self.joined(percent, self.roots, self.roots)

    @staticmethod
    def _possible(nodes: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        bits, low, high, first, last, over = nodes
        # some two members of different components, and sizes that can be near enough
        keep = ~((first[x] == last[x]) & (first[y] == last[y]) & (first[x] == first[y]))
        keep &= (high[x] * 100 >= percent * low[y]) & (high[y] * 100 >= percent * low[x])
        at = np.flatnonzero(keep)
        for start in range(0, len(at), 8192):
            own = at[start : start + 8192]
            a, b = x[own], y[own]
            # a member's shingles beyond the other side's bits are not shared
            shared = np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64) + np.minimum(over[a], over[b])
            most = np.minimum(shared, np.minimum(high[a], high[b]))
            # overlap o of sets of n1 and n2 shingles reaches the threshold where o * (100 + percent) >= percent * (n1 + n2)
            keep[own] = most * (100 + percent) >= percent * (low[a] + low[b])
        return keep


FOUND = "a long, b long, key long, node long, size int, low long, high long, first long, last long, members binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _emit(forest: Forest, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    pairs = np.sort(np.stack([forest.rep[x], forest.rep[y]], axis=1), axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of at most FIRST keys as rows, filled up with more than any key."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(size), FIRST), 1 << 62, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _traversed(groups: DataFrame, labels: DataFrame, classes: DataFrame, homes: DataFrame, percent: int, tasks: int, few: bool) -> DataFrame:
    """Pairs (a, b) that the traversal of each subtree leaves; and the subtrees of groups that may be spread over more than one, with their members.

    ``few``: of pairs the likeliest, and besides keys only, of groups with others and of groups that may be spread.
    """
    labelled = groups.join(labels, groups["rep"] == labels["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    left = labelled.join(mixed, "key", "left_semi").join(classes.select("rep", F.col("n_shingles").alias("n"), "bitmap").join(homes, ["rep", "n"]), ["rep", "n"])
    ordered = left.repartitionByRange(tasks, "key", "component", "n", "rep").sortWithinPartitions("key", "component", "n", "rep").withColumn("part", F.spark_partition_id())

    def work(batches):
        count, opening, held = 0, None, []
        for table in _whole_runs(batches, "key"):
            keys = table["key"].to_numpy()
            rep, n, component, part = (table[c].to_numpy() for c in ("rep", "n", "component", "part"))
            bits = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
            first = _padded(table["homes"].combine_chunks())
            edges = _runs(keys)
            cuts = np.unique(np.concatenate([edges, *(np.arange(a, b, NODE) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False) if b - a > NODE)])).astype(np.int64)
            weight = np.cumsum(np.diff(cuts).astype(np.int64) ** 2)
            edge = np.unique(np.concatenate([[0], np.searchsorted(weight, np.arange(TOGETHER, int(weight[-1]) + TOGETHER, TOGETHER), side="right"), [len(cuts) - 1]]))
            for x, y in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                a, b = int(cuts[x]), int(cuts[y])
                forest = Forest(rep[a:b], n[a:b], component[a:b], bits[a:b], cuts[x : y + 1] - a, keys[a:b], first[a:b])
                one, two = forest.pairs(percent)
                if few:
                    likely = forest.likeliest(one, two)
                    again = np.unique(forest.key[one[~likely]]).tolist()
                    if again:
                        yield _key_rows(again)
                    one, two = one[likely], two[likely]
                pairs = _emit(forest, one, two)
                if not len(pairs):
                    continue
                nothing = [pa.nulls(len(pairs), t) for t in _KINDS[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *nothing], names=_NAMES)
            if few:
                yield _key_rows(sorted({int(keys[0]), int(keys[-1])}.union(keys[a] for a in cuts[:-1].tolist() if a and keys[a - 1] == keys[a])))
                continue
            rows = []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                # the first and the last group of a task may go on in another; so may a run longer than a table
                whole = keys[a] != keys[0] and keys[a] != keys[-1] and (a == 0 or keys[a - 1] != keys[a]) and keys[b] != keys[a]
                if not whole:
                    members = rep[a:b].tobytes() + n[a:b].tobytes() + component[a:b].tobytes() + bits[a:b].tobytes() + first[a:b].tobytes()
                    rows.append((None, None, int(keys[a]), int(part[0]) << 32 | count, b - a, int(n[a:b].min()), int(n[a:b].max()), int(component[a:b].min()), int(component[a:b].max()), members))
                    count += 1
            # those of the table's last key wait for the next table; a task's first key may be spread, others if they have several subtrees
            opening = int(keys[0]) if opening is None else opening
            every, last = held + rows, int(keys[-1])
            times = Counter(r[2] for r in every)
            held = [r for r in every if r[2] == last]
            sure = [r for r in every if r[2] != last and (r[2] == opening or times[r[2]] > 1)]
            if sure:
                yield _node_rows(sure)
        if held:
            yield _node_rows(held)

    return map_arrow(ordered, work, FOUND)


def _key_rows(keys: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, t) if name == "key" else pa.nulls(len(keys), t) for name, t in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _node_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _between(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of two subtrees of a spread group, after the same pruning of the roots."""

    def members(size: int, raw: bytes) -> tuple:
        values, words = np.frombuffer(raw, np.int64), 3 + BITMAP // 64
        bits, first = values[3 * size : words * size].view(np.uint64).reshape(size, -1), values[words * size :].reshape(size, FIRST)
        return values[:size], values[size : 2 * size], values[2 * size : 3 * size], bits, first

    def work(batches):
        for batch in batches:
            for key, s1, m1, s2, m2 in zip(batch.column("key").to_pylist(), batch.column("size").to_pylist(), batch.column("members"), batch.column("size2").to_pylist(), batch.column("members2"), strict=True):
                *both, first = (np.concatenate(c) for c in zip(members(s1, m1.as_py()), members(s2, m2.as_py()), strict=True))
                forest = Forest(*both, np.array([0, s1, s1 + s2]), np.full(s1 + s2, key), first)
                pairs = _emit(forest, *forest.joined(percent, np.zeros(1, np.int64), np.ones(1, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    spread = nodes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    some = nodes.join(spread, "key", "left_semi")
    other = some.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "size", "low", "high", "first", "last", "members")))
    linked = (F.col("first") == F.col("last")) & (F.col("first2") == F.col("last2")) & (F.col("first") == F.col("first2"))
    near = (F.col("high") * 100 >= F.col("low2") * percent) & (F.col("high2") * 100 >= F.col("low") * percent)
    across = some.join(other, "key").where((F.col("node") < F.col("node2")) & near & ~linked)
    return map_arrow(across.select("key", "size", "members", "size2", "members2"), work, PAIRS)


def _further(groups: DataFrame, links: DataFrame, classes: DataFrame, homes: DataFrame, docs: DataFrame, width: int, percent: int, tasks: int, scratch: Scratch) -> DataFrame:
    """``links`` with what they lack: links of the likeliest pairs of two components, then of all pairs that are not linked by then."""
    found = scratch.table(_traversed(groups, components(links, scratch), classes, homes, percent, tasks, True), "likeliest")
    tried = scratch.table(found.where("a is not null").select("a", "b").distinct(), "tried")
    links = scratch.table(links.unionByName(_verify(tried, docs, width, percent, scratch)), "links")
    again = groups.join(found.where("a is null").select("key").distinct(), "key", "left_semi")
    found = scratch.table(_traversed(again, components(links, scratch), classes, homes, percent, tasks, False), "traversed")
    pairs = found.where("a is not null").select("a", "b").unionByName(_between(found.where("a is null").drop("a", "b"), percent)).distinct()
    return links.unionByName(_verify(pairs.join(tried, ["a", "b"], "left_anti"), docs, width, percent, scratch))


def link(docs: DataFrame, scratch: Scratch, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of ``docs`` (doc_id long, text).

    Two documents link where 100 * shared shingles >= percent * all shingles of both.
    """
    spark = docs.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = scratch.table(_describe(docs, width, percent), "described")
    first = scratch.table(described.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "first")
    classes = described.where(F.length("bitmap") > 0).drop("parts").join(first, ["d1", "d2"]).where("doc_id = rep").select("rep", "d1", "d2", "n_shingles", "bitmap")
    # an id that repeats may stand for several sets; each is there once
    classes = scratch.table(classes.dropDuplicates(["rep", "d1", "d2"]).select("rep", "n_shingles", "bitmap"), "classes")
    groups = scratch.table(_different(scratch.table(_shared_groups(described, classes, tasks), "shared")), "groups")
    homes = scratch.table(_homes(groups), "homes")
    links = scratch.table(_verify(_possible_pairs(_chains(homes, percent, tasks), classes, percent), docs, width, percent, scratch), "links")
    # rows of one id are one document, whichever classes their sets are of
    owned = described.select("doc_id", "n_shingles", "d1", "d2").join(first, ["d1", "d2"], "left")
    several = described.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id")
    same = owned.join(several, "doc_id", "left_semi").where("rep is not null").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.table(links.unionByName(same), "links")
    labels = components(_further(groups, links, classes, homes, docs, width, percent, tasks, scratch), scratch)
    found = owned.join(labels, owned["rep"] == labels["node"], "left")
    return found.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
