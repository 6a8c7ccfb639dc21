"""Toxicity by the nearest labelled examples.

Examples (copies of a text count once) and documents are TF-IDF vectors over all words of the examples, and over
word beginnings (4, 5 and 6 bytes) whose presence goes with the label; document frequencies come from all documents.
Terms chosen by chi-square and lift on the examples are only weighted: in a text that has some, they are CHOSEN_SHARE
of its squared length.

The index is a block-max inverted index: examples of like vectors lie side by side (k-means over the COMMON
most frequent terms) in blocks of BLOCK, and of each common term every block has its largest weight. Postings of the
other terms are added up; a block's bound is the best such sum in it and, for the common terms, the query's weights
times the block's largest. The blocks of the highest bounds give the k-th best cosine so far, and of the others only those
that may reach it have their common terms multiplied. The nearest are computed again in full precision, so
neighbours are exact. Votes weighted by similarity are calibrated by logistic regression on leave-one-out votes, apart for texts
with and without chosen terms. Evidence (ids, cosines and labels of the nearest examples) is returned.

Bounds of what is learned: MAX_EXAMPLES labelled rows, MAX_TERMS terms that weigh more, MAX_CALIBRATION of the
examples for the calibration. The index holds all words of the examples, and every text is searched for.

Defined results: a text without a word of any example, an empty text and a null text get the smoothed rate
of such examples; without examples, or with one class only, every score is the smoothed base rate.
Equal vectors get equal scores; ties between neighbours go to the smaller example id. Of repeated
label rows of an id the most toxic counts; of repeated document rows each gets a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, each_slice, map_arrow, one_thread, ship, slices
from .hashing import LETTERS, spans, words

#: Bounds of what is learned: labelled rows (a hash of the id chooses them) and terms.
MAX_EXAMPLES = 20_000
MAX_TERMS = 4096
MAX_CALIBRATION = 2000
#: A term is of use where the label's share among its texts is so many times that among all.
LIFT = 2.0
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
CHOSEN_SHARE = 0.9
#: Common terms, examples of a block, clusters that order them, queries of one product, and more than its error in single precision.
COMMON, BLOCK, CLUSTERS, TOGETHER, MARGIN = 512, 64, 64, 256, 1e-4
#: Blocks of the highest bounds that give the first k-th best.
FIRST = 3
TABLE_BITS = 20


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Term hashes of all texts and the text each belongs to."""
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    found = words(lowered, LETTERS)
    hashes, docs = [found.hashes], [found.doc]
    for length in PREFIXES:
        value, at = found.prefix(length)
        hashes.append(value)
        docs.append(found.doc[at])
    return np.concatenate(hashes), np.concatenate(docs), len(lowered)


class Places:
    """Places of hashes in sorted keys: a table by their low bits, a search where two keys meet there."""

    def __init__(self, keys: np.ndarray, bits: int = TABLE_BITS):
        self.keys, self.mask = keys, np.uint64((1 << bits) - 1)
        low = (keys & self.mask).astype(np.int64)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[low] = np.arange(len(keys))
        self.shared = np.bincount(low, minlength=1 << bits) > 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        low = (hashes & self.mask).astype(np.int64)
        at = self.table[low].astype(np.int64)
        miss = self.keys[at] != hashes
        again = np.flatnonzero(miss & self.shared[low])
        at[miss] = -1
        found = np.minimum(np.searchsorted(self.keys, hashes[again]), len(self.keys) - 1)
        good = self.keys[found] == hashes[again]
        at[again[good]] = found[good]
        return at


class Terms:
    """Terms of texts by their places in sorted keys. Word beginnings are looked up among the chosen terms only, which hold all that count."""

    def __init__(self, keys: np.ndarray, chosen: np.ndarray):
        self.size = len(keys) + 1
        self.words, self.begins, self.chosen = Places(keys), Places(keys[chosen], 16), np.flatnonzero(chosen)

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and counts of all texts, by text; and where each text's begin."""
        lowered = pc.utf8_lower(pc.fill_null(column, ""))
        found = words(lowered, LETTERS)
        at = self.words(found.hashes)
        hit = at >= 0
        both = [found.doc[hit] * self.size + at[hit]]
        for length in PREFIXES if len(self.chosen) else ():
            value, own = found.prefix(length)
            at = self.begins(value)
            hit = at >= 0
            both.append(found.doc[own[hit]] * self.size + self.chosen[at[hit]])
        both, counts = np.unique(np.concatenate(both), return_counts=True)
        return both % self.size, counts, np.searchsorted(both // self.size, np.arange(len(lowered) + 1))


@dataclass
class Index:
    """Unit example vectors, by example; ``prepare`` lays them out by term and block."""

    keys: np.ndarray  # sorted term hashes
    idf: np.ndarray
    chosen: np.ndarray  # which terms chi-square chose
    ids: np.ndarray  # example ids, in index order
    labels: np.ndarray
    cuts: np.ndarray  # where each example's terms begin
    terms: np.ndarray
    counts: np.ndarray  # two bytes each where that is enough
    prior: float
    blank: float
    fits: tuple = ((1.0, 0.0), (1.0, 0.0))  # slope and shift for texts without and with chosen terms
    k: int = NEIGHBOURS
    tables: tuple | None = None

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = (1.0 + np.log(np.asarray(counts, float))) * self.idf[terms]
        square, chosen = weight * weight, self.chosen[terms]
        own, rest = np.sum(square[chosen]), np.sum(square[~chosen])
        if own and rest:
            return weight * np.where(chosen, np.sqrt(CHOSEN_SHARE / own), np.sqrt((1.0 - CHOSEN_SHARE) / rest))
        return weight / np.sqrt(own + rest) if len(weight) else weight

    def _weights(self) -> np.ndarray:
        """``vector`` of all examples in single precision, some at a time; and the factors of each example's chosen and other terms."""
        out, self.scale = np.zeros(len(self.terms), np.float32), np.ones((2, len(self.ids)))
        for first in range(0, len(self.ids), 2000):
            cuts = self.cuts[first : first + 2001]
            part, cuts = slice(cuts[0], cuts[-1]), cuts - cuts[0]
            weight = (1.0 + np.log(self.counts[part].astype(float))) * self.idf[self.terms[part]]
            square, chosen = weight * weight, self.chosen[self.terms[part]]
            own, rest = np.add.reduceat(np.where(chosen, square, 0.0), cuts[:-1]), np.add.reduceat(np.where(chosen, 0.0, square), cuts[:-1])
            both, whole = (own > 0) & (rest > 0), np.sqrt(own + rest)
            some = slice(first, first + len(own))
            self.scale[0, some] = np.sqrt(CHOSEN_SHARE / np.where(both, own, CHOSEN_SHARE * whole**2))
            self.scale[1, some] = np.sqrt((1.0 - CHOSEN_SHARE) / np.where(both, rest, (1.0 - CHOSEN_SHARE) * whole**2))
            factor = np.repeat(self.scale[:, some], np.diff(cuts), axis=1)
            out[part] = weight * np.where(chosen, factor[0], factor[1])
        return out

    def _exact(self, at: np.ndarray, example: np.ndarray) -> np.ndarray:
        """Weights in full precision of the given terms of the given examples."""
        terms = self.terms[at]
        return self.tables[-1][self.counts[at]] * self.idf[terms] * np.where(self.chosen[terms], self.scale[0, example], self.scale[1, example])

    def prepare(self) -> None:
        """Tables that are cheaper to make in the worker than to send."""
        if self.tables is not None:
            return
        one_thread()
        n, weights = len(self.ids), self._weights()
        common = np.sort(np.argsort(-np.bincount(self.terms, minlength=len(self.keys)), kind="stable")[:COMMON])
        column = np.full(len(self.keys), -1, np.int32)
        column[common] = np.arange(len(common))
        blocks = -(-n // BLOCK)
        dense = np.zeros((blocks, len(common), BLOCK), np.float32)
        owner, rare = np.zeros(len(self.terms), np.int32), []
        for first in range(0, n, 2000):
            cuts = self.cuts[first : first + 2001]
            part = slice(int(cuts[0]), int(cuts[-1]))
            at, own = np.repeat(np.arange(first, first + len(cuts) - 1), np.diff(cuts)), column[self.terms[part]]
            owner[part] = at
            some = own >= 0
            dense[at[some] // BLOCK, own[some], at[some] % BLOCK] = weights[part][some]
            rare.append(np.flatnonzero(~some) + part.start)
        rare = np.concatenate([np.zeros(0, np.int64), *rare])
        rare |= self.terms[rare].astype(np.int64) << 32
        rare.sort()
        starts = np.searchsorted(rare, np.arange(len(self.keys) + 1, dtype=np.int64) << 32)
        rare &= 0xFFFFFFFF
        logs = 1.0 + np.log(np.maximum(np.arange(int(self.counts.max(initial=0)) + 1), 1.0))
        most = np.ascontiguousarray(dense.max(axis=2).T) if blocks else np.zeros((len(common), 0), np.float32)
        self.tables = column, dense, most, starts, owner[rare].astype(np.int64), weights[rare], np.zeros(len(self.keys)), np.arange(1 << 18), logs

    def release(self) -> None:
        self.tables = self.scale = None

    def nearest(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (ties: smaller id), ``skip`` left out."""
        return self.search([(terms, weights, skip)])[0]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each (terms, weights, skip)."""
        self.prepare()
        column, _, most = self.tables[:3]
        out: list = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if not len(self.ids):
            return out
        wanted = np.zeros((len(queries), len(most)), np.float32)
        for row, (terms, weights, _) in zip(wanted, queries, strict=True):
            own = column[terms]
            row[own[own >= 0]] = weights[own >= 0]
        alike = np.argsort((wanted @ most).argmax(axis=1), kind="stable")
        for start in range(0, len(alike), TOGETHER):
            group = alike[start : start + TOGETHER]
            for place, found in zip(group.tolist(), self._together([queries[i] for i in group], wanted[group]), strict=True):
                out[place] = found
        return out

    def _together(self, queries: list, wanted: np.ndarray):
        column, _, most, starts, places, parts, query, count, _ = self.tables
        rows, blocks = len(queries), most.shape[1]
        scores = np.zeros((rows, blocks * BLOCK), np.float32)
        for row, (terms, weights, skip) in zip(scores, queries, strict=True):
            rare = column[terms] < 0
            begin = starts[terms[rare]]
            n = starts[terms[rare] + 1] - begin
            at = np.repeat(begin - np.cumsum(n) + n, n)
            at += count[: len(at)] if len(at) <= len(count) else np.arange(len(at))
            value = np.repeat(weights[rare].astype(np.float32), n)
            value *= parts[at]
            row += np.bincount(places[at], value, len(row))
            if skip >= 0:
                row[skip] = -2.0  # common terms add less than 2
        bound = wanted @ most + scores.reshape(rows, blocks, BLOCK).max(axis=2)
        best = np.argpartition(bound, max(blocks - FIRST, 0), axis=1)[:, max(blocks - FIRST, 0) :]
        first = np.zeros((rows, blocks), bool)
        first[np.arange(rows)[:, None], best] = True
        self._add(first, scores, wanted)
        seen = scores.reshape(rows, blocks, BLOCK)[np.arange(rows)[:, None], best].reshape(rows, -1)
        bar = np.maximum(np.partition(seen, -self.k, axis=1)[:, -self.k], 0.0) if seen.shape[1] > self.k else np.zeros(rows)
        self._add((bound >= bar[:, None] - MARGIN) & ~first, scores, wanted)
        # a block left out has sums without its common terms, below the bar in any case
        for values, low, (terms, weights, _) in zip(scores, bar.tolist(), queries, strict=True):
            near = np.flatnonzero(values >= max(low - MARGIN, 1e-9))
            if len(near) > self.k:
                near = near[values[near] >= np.partition(values[near], -self.k)[-self.k] - MARGIN]
            at, owner = spans(self.cuts[near], self.cuts[near + 1])
            query[terms] = weights
            cosine = np.round(np.bincount(owner, self._exact(at, near[owner]) * query[self.terms[at]], len(near)), 12)
            query[terms] = 0.0
            kept = np.lexsort((self.ids[near], -cosine))[: self.k]
            yield near[kept], cosine[kept]

    def _add(self, wanted_blocks: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> None:
        """The common terms' part of the scores, for pairs of a query and a block."""
        dense = self.tables[1]
        for block in np.flatnonzero(wanted_blocks.any(axis=0)).tolist():
            rows = np.flatnonzero(wanted_blocks[:, block])
            scores[rows, block * BLOCK : (block + 1) * BLOCK] += wanted[rows] @ dense[block]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine * cosine
        return float((np.sum(weight * self.labels[at]) + 0.5 * self.prior) / (np.sum(weight) + 0.5))

    def calibrated(self, vote: float, terms: np.ndarray) -> float:
        slope, shift = self.fits[int(self.chosen[terms].any())]
        return float(1.0 / (1.0 + np.exp(-np.clip(slope * np.log(vote / (1.0 - vote)) + shift, -40, 40))))


def _rate(positive: float, total: float, prior: float) -> float:
    return float((positive + prior) / (total + 1.0))


def _alike(terms: np.ndarray, weights: np.ndarray, cuts: np.ndarray, n_terms: int, steps: int = 6) -> np.ndarray:
    """Cluster of each example by its common terms; it only orders the index."""
    n = len(cuts) - 1
    common = np.argsort(-np.bincount(terms, minlength=n_terms), kind="stable")[: COMMON // 2]
    column = np.full(n_terms, -1, np.int32)
    column[common] = np.arange(len(common))
    vectors = np.zeros((n, len(common)), np.float32)
    for first in range(0, n, 2000):
        part = slice(cuts[first], cuts[min(first + 2000, n)])
        own, at = column[terms[part]], np.repeat(np.arange(first, min(first + 2000, n)), np.diff(cuts[first : first + 2001]))
        vectors[at[own >= 0], own[own >= 0]] = weights[part][own >= 0]
    centres = vectors[:: max(1, n // CLUSTERS)][:CLUSTERS].copy()
    nearest = np.zeros(n, np.int64)
    for _ in range(steps):
        nearest = (vectors @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            total = vectors[nearest == k].sum(axis=0)
            centres[k] = total / max(float(np.linalg.norm(total)), 1e-9)
    return nearest


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint16 if not len(counts) or int(counts.max()) < 1 << 16 else np.int32)


def build(keys: np.ndarray, idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], k: int = NEIGHBOURS, chosen: np.ndarray | None = None) -> Index:
    """``examples``: (id, label, term places, counts); ``chosen``: which terms weigh more."""
    none = np.zeros(0, np.int32)
    ids, labels = np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], float)
    terms, counts = np.concatenate([none, *(e[2] for e in examples)]), np.concatenate([none, *(e[3] for e in examples)])
    index = Index(keys, idf, np.zeros(len(keys), bool) if chosen is None else chosen, ids, labels, np.cumsum([0, *(len(e[2]) for e in examples)]), terms.astype(np.int32), _narrow(counts), 0.0, 0.0, k=k)
    _finish(index)
    some = _calibration_places(index)
    index.fits = _fits(*_votes(index, some), index.labels[some])
    index.release()
    return index


def _finish(index: Index) -> Index:
    """Examples without terms left out, the others put beside those like them; rates."""
    index.prior = _rate(index.labels.sum(), len(index.ids), 0.1)
    sizes = np.diff(index.cuts)
    blank = index.labels[sizes == 0]
    index.blank = _rate(blank.sum(), len(blank), index.prior)
    some = np.flatnonzero(sizes)
    index.ids, index.labels, index.cuts = index.ids[some], index.labels[some], np.concatenate([[0], np.cumsum(sizes[some])])
    if len(some):
        order = np.argsort(_alike(index.terms, index._weights(), index.cuts, len(index.keys)), kind="stable")
        places, _ = spans(index.cuts[order], index.cuts[order + 1])
        index.ids, index.labels, index.terms, index.counts = index.ids[order], index.labels[order], index.terms[places], index.counts[places]
        index.cuts = np.concatenate([[0], np.cumsum(sizes[some][order])])
        del places
    return index


def _calibration_places(index: Index) -> np.ndarray:
    """The examples whose leave-one-out votes calibrate; none where there are too few or all are of one class."""
    n = len(index.ids)
    if n < 20 or len(np.unique(index.labels)) < 2:
        return np.zeros(0, np.int64)
    return np.arange(0, n, -(-n // MAX_CALIBRATION))


def _votes(index: Index, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leave-one-out votes of examples, and which of them have chosen terms."""
    index.prepare()
    own = [slice(index.cuts[i], index.cuts[i + 1]) for i in some]
    votes = [index.vote(at, cosine) for at, cosine in index.search([(index.terms[o], index.vector(index.terms[o], index.counts[o]), int(i)) for i, o in zip(some, own, strict=True)])]
    return np.array(votes, float), np.array([index.chosen[index.terms[o]].any() for o in own], bool)


def _fits(votes: np.ndarray, with_chosen: np.ndarray, labels: np.ndarray) -> tuple:
    """Logistic regressions of the label on the logit of the vote, of texts without and with chosen terms; of all where a kind has too few."""
    if not len(votes):
        return (1.0, 0.0), (1.0, 0.0)
    x = np.log(votes / (1 - votes))
    whole = _fit(x, labels)
    groups = [with_chosen == g for g in (False, True)]
    return tuple(_fit(x[g], labels[g]) if g.sum() >= 20 and len(np.unique(labels[g])) == 2 else whole for g in groups)


def _calibrated_on(spark, shared, some: np.ndarray, labels: np.ndarray) -> tuple:
    """``_fits`` of a broadcast index, its votes found on the executors."""
    if not len(some):
        return _fits(np.zeros(0), np.zeros(0, bool), labels)

    def work(batches):
        for batch in batches:
            places = batch.column("id").to_numpy()
            votes, with_chosen = _votes(shared.value, places)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(votes), pa.array(with_chosen)], names=["place", "vote", "chosen"])
        shared.value.release()

    step = int(some[1] - some[0])
    found = map_arrow(spark.range(0, int(some[-1]) + 1, step, 4), work, "place long, vote double, chosen boolean").toArrow().sort_by("place")
    return _fits(found["vote"].to_numpy(), found["chosen"].to_numpy(), labels[some])


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    beta, ridge = np.array([1.0, 0.0]), 1.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * (beta - [1.0, 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.05), float(beta[1])


def _select(key: np.ndarray, pos: np.ndarray, all_: np.ndarray, positives: int, total: int) -> np.ndarray:
    """Sorted hashes of the terms whose chi-square stands out among all that were tried."""
    if not len(key):
        return np.zeros(0, np.uint64)
    key, pos, all_ = key.view(np.uint64), pos.astype(float), all_.astype(float)
    a, b = pos, all_ - pos
    c, d = positives - a, total - positives - b
    chi = total * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    good = np.flatnonzero((chi >= 2 * np.log(len(key) / 0.01)) & (a * total >= LIFT * all_ * positives))
    good = good[np.lexsort((key[good], -chi[good]))][:MAX_TERMS]
    return np.sort(key[good])


def learn_terms(examples: DataFrame) -> tuple[np.ndarray, int]:
    """Term hashes chosen on (text, label) rows; and how many rows there were."""

    def work(batches):
        seen = positive = 0
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                label = part.column("label").to_numpy(zero_copy_only=False)
                hashes, doc, n = _terms(part.column("text"))
                order = np.argsort(hashes, kind="stable")  # of one term, texts stay in order
                hashes, doc = hashes[order], doc[order]
                fresh = np.ones(len(hashes), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                key, back = np.unique(hashes[fresh], return_inverse=True)
                parts.append((key, np.bincount(back, label[doc[fresh]], len(key)), np.bincount(back, minlength=len(key)).astype(float)))
                seen, positive = seen + n, positive + int(label.sum())
        if not parts:
            return
        keys = np.concatenate([p[0] for p in parts])
        key, back = np.unique(keys, return_inverse=True)
        toxic = np.append(np.bincount(back, np.concatenate([p[1] for p in parts]), len(key)), positive)
        total = np.append(np.bincount(back, np.concatenate([p[2] for p in parts]), len(key)), seen)
        key = np.concatenate([key, np.zeros(1, np.uint64)])
        marker = np.zeros(len(key), bool)
        marker[-1] = True
        yield pa.RecordBatch.from_arrays([pa.array(marker), pa.array(key.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(total.astype(np.int64))], names=["whole", "term", "pos", "total"])

    counted = map_arrow(examples.select("text", "label"), work, "whole boolean, term long, pos long, total long").groupBy("whole", "term").agg(F.sum("pos").alias("pos"), F.sum("total").alias("total")).where("whole or total >= 3")
    rows = counted.where("whole or pos >= 1 or total >= 30").select("whole", "term", "pos", "total").toArrow()
    whole = rows.filter(rows["whole"]).to_pylist()
    terms = rows.filter(pc.invert(rows["whole"]))
    if not whole:
        return np.zeros(0, np.uint64), 0
    positives, total = whole[0]["pos"], whole[0]["total"]
    return _select(*(terms[c].to_numpy() for c in ("term", "pos", "total")), positives, total), total


def example_terms(examples: DataFrame, chosen: np.ndarray) -> pa.Table:
    """doc_id, label and distinct term hashes of the examples: all words, and the chosen of the word beginnings."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(pc.utf8_lower(pc.fill_null(batch.column("text"), "")), LETTERS)
        hashes, doc, n = _terms(batch.column("text"))
        kept = np.isin(hashes, chosen)
        kept[: len(found.hashes)] = True
        order = np.lexsort((hashes[kept], doc[kept]))
        key, doc = hashes[kept][order], doc[kept][order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        edges = np.append(np.flatnonzero(fresh), len(key))
        offsets = pa.array(np.searchsorted(doc[fresh], np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(key[fresh].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(edges).astype(np.int32)))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "terms", "counts"])

    return map_arrow(examples.select("doc_id", "label", "text"), each_slice(work), "doc_id long, label int, terms array<long>, counts array<int>").toArrow()


def frequencies(docs: DataFrame, keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows have each term; and how many rows there are."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, chosen))

    def work(batches):
        known, n, rows = Terms(*shared.value), np.zeros(len(shared.value[0]), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                n += np.bincount(known.count(part.column("text"))[0], minlength=len(n))
                rows += part.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], rows))], names=["term", "n"])

    rows = map_arrow(docs.select("text"), work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(len(keys), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


SCORED = "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>"


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, learnable=None, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, score, predicted, evidence) of every row of ``docs`` (doc_id long, text).

    ``labels``: doc_id, toxic; ``learnable``: a column condition on doc_id of the rows to learn from.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if learnable is not None:
        known = known.where(learnable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = scratch.table(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples), "examples")
    # at most max_examples rows of two numbers, whatever the input
    examples = docs.where("doc_id is not null").join(F.broadcast(chosen), "doc_id")
    # copies of a text are one example: of at most max_examples ids, by a hash of the text
    first = F.row_number().over(Window.partitionBy("same").orderBy(F.col("label").desc(), "doc_id"))
    examples = scratch.table(examples.withColumn("same", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("first", first).where("first = 1").select("doc_id", "text", "label", "same"), "different")
    if examples.count() > max_examples:  # where ids repeat
        some = scratch.table(examples.select("same", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "same").limit(max_examples).select("same"), "bounded")
        examples = examples.join(F.broadcast(some), "same", "left_semi")
    picked, _ = learn_terms(examples)
    learned = example_terms(examples, picked).combine_chunks().sort_by("doc_id")
    terms, cuts = _flat(learned["terms"])
    counts, _ = _flat(learned["counts"])
    ids, marks = learned["doc_id"].to_numpy(), learned["label"].to_numpy().astype(float)
    del learned
    keys = np.unique(terms).view(np.uint64)
    keys.sort()
    places = np.searchsorted(keys, terms.view(np.uint64)).astype(np.int32)
    del terms
    pa.default_memory_pool().release_unused()
    chosen = np.isin(keys, picked)
    df, total = frequencies(docs, keys, chosen)
    index = Index(keys, np.log((1 + total) / (1 + df)) + 1.0, chosen, ids, marks, cuts, places, _narrow(counts), 0.0, 0.0)
    del places, counts
    _finish(index)
    shared = spark.sparkContext.broadcast(index)
    fits = _calibrated_on(spark, shared, _calibration_places(index), index.labels)
    del index

    def work(batches):
        index = shared.value
        index.fits = fits
        known = Terms(index.keys, index.chosen)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        def scored(held):
            """Rows of (ids, queries) of some slices, searched for together."""
            queries = [q for _, own in held for q in own]
            scores, evidence = np.full(len(queries), index.blank), [[] for _ in queries]
            some = [i for i, (terms, _, _) in enumerate(queries) if len(terms)]
            for i, (at, cosine) in zip(some, index.search([queries[i] for i in some]), strict=True):
                if len(at):
                    scores[i] = index.calibrated(index.vote(at, cosine), queries[i][0])
                    evidence[i] = [{"doc_id": int(index.ids[a]), "cosine": float(c), "label": int(index.labels[a])} for a, c in zip(at[:5], cosine[:5], strict=True)]
            scores = np.clip(scores, 0.0, 1.0)
            ids = pa.concat_arrays([ids for ids, _ in held])
            return pa.RecordBatch.from_arrays([ids, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, kind)], names=["doc_id", "score", "predicted", "evidence"])

        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                terms, counts, cuts = known.count(part.column("text"))
                own = [(terms[a:b], index.vector(terms[a:b], counts[a:b]), -1) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                held.append((part.column("doc_id"), own))
                rows += part.num_rows
                if rows >= 3 * TOGETHER:
                    yield scored(held)
                    held, rows = [], 0
        if held:
            yield scored(held)
        index.release()  # a worker that goes on to other stages does not keep them

    return map_arrow(docs, work, SCORED)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each list's begin."""
    sizes = pc.list_value_length(column).to_numpy()
    return pc.list_flatten(column).to_numpy(), np.cumsum([0, *sizes])
