"""Character n-gram language models in sorted hash arrays, built and scored with numpy.

Every order has one table for all classes: sorted 64-bit n-gram hashes with, per class, the
interpolated log-probability, and sorted context hashes with the log back-off weights. Two
smoothings are offered: interpolated Kneser-Ney ("kn") and Witten-Bell over variable-length
contexts ("wb", contexts seen fewer than ``min_context`` times are left to shorter ones).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .hashing import BASE, mix

BORDER = 32


@dataclass
class Order:
    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    """``orders[k]`` serves n-grams of k + 1 characters; ``floor`` is a character never seen, per class."""

    orders: list[Order]
    floor: np.ndarray


def _chain(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of 1..order characters that begin at each place (shorter arrays for longer ones)."""
    keys = [mix(codes.astype(np.uint64) + np.uint64(1))]
    for k in range(1, order):
        tail = codes[k:].astype(np.uint64) + np.uint64(1)
        keys.append(mix(keys[-1][: len(tail)] * np.uint64(BASE) + tail))
    return keys


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def _counts(streams: list[np.ndarray], order: int, smoothing: str, min_context: int):
    """Per order: n-gram keys with count, context key and suffix key, for one class."""
    levels: list[list[tuple]] = [[] for _ in range(order)]
    for codes in streams:
        chain = _chain(codes, order)
        for k in range(order):
            full = chain[k]
            prefix = chain[k - 1][: len(full)] if k else np.zeros(len(full), np.uint64)
            suffix = chain[k - 1][1 : 1 + len(full)] if k else np.zeros(len(full), np.uint64)
            levels[k].append((full, prefix, suffix))
    out = []
    for parts in levels:
        full, prefix, suffix = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(3))
        keys, first, count = np.unique(full, return_index=True, return_counts=True)
        out.append([keys, count.astype(np.float64), prefix[first], suffix[first]])
    if smoothing == "kn":
        for k in range(order - 1):  # below the top, how many different characters come before
            suffix, kinds = np.unique(out[k + 1][3], return_counts=True)
            at = find(suffix, out[k][0])
            out[k][1] = np.where(at >= 0, kinds[at] if len(kinds) else 0, 0).astype(np.float64)
    else:
        for k in range(1, order):
            context, back = np.unique(out[k][2], return_inverse=True)
            kept = np.bincount(back, out[k][1], len(context))[back] >= min_context
            out[k] = [x[kept] for x in out[k]]
    return out


def train(classes: list[list[np.ndarray]], order: int, smoothing: str = "kn", min_context: int = 2, alphabet: int = 0) -> Model:
    """A joint model of several classes; ``classes[c]`` is that class's list of code arrays."""
    counted = [_counts(streams, order, smoothing, min_context) for streams in classes]
    size = len(classes)
    seen = np.unique(np.concatenate([c[0][0] for c in counted])) if counted else np.zeros(0, np.uint64)
    uniform = 1.0 / (max(alphabet, len(seen)) + 1)
    orders: list[Order] = []
    floor = np.zeros(size)
    for k in range(order):
        keys, first = np.unique(np.concatenate([c[k][0] for c in counted]), return_index=True)
        prefix = np.concatenate([c[k][2] for c in counted])[first]
        suffix = np.concatenate([c[k][3] for c in counted])[first]
        contexts = np.unique(prefix)
        prob, weight = np.zeros((len(keys), size)), np.ones((len(contexts), size))
        if k:
            below = orders[-1]
            lower = np.exp(below.logp[find(below.keys, suffix)])
        else:
            lower = np.full((len(keys), size), uniform)
        for c in range(size):
            own, count, own_prefix, _ = counted[c][k]
            positive = count > 0
            own, count, own_prefix = own[positive], count[positive], own_prefix[positive]
            group = find(contexts, own_prefix)
            total, kinds = np.bincount(group, count, len(contexts)), np.bincount(group, minlength=len(contexts))
            some = total > 0
            if smoothing == "kn":
                once, twice = np.sum(count == 1), np.sum(count == 2)
                cut = float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.1, 0.95))
                weight[some, c] = cut * kinds[some] / total[some]
                taken = np.maximum(count - cut, 0) / total[group]
            else:
                weight[some, c] = kinds[some] / (total[some] + kinds[some])
                taken = count / (total[group] + kinds[group])
            prob[find(keys, own), c] = taken
            prob[:, c] += weight[find(contexts, prefix), c] * lower[:, c]
        if k == 0:
            floor = np.log((weight[0] if len(weight) else np.ones(size)) * uniform)
        orders.append(Order(keys, np.log(np.maximum(prob, 1e-300)).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
    return Model(orders, floor.astype(np.float32))


def score(model: Model, codes: np.ndarray) -> np.ndarray:
    """Log-probability per class of the n-gram that ends at each place, shorter ones at the start: (len(codes), classes)."""
    order, size = len(model.orders), len(model.floor)
    out = np.zeros((len(codes), size), np.float32)
    if not len(codes):
        return out
    chain = _chain(codes, order)
    ends = [np.arange(len(c)) + k for k, c in enumerate(chain)]
    # places that are served by a top-order n-gram first, then what is left by shorter ones
    pending = ends[-1]
    for k in range(order - 1, -1, -1):
        if k < order - 1 and k < len(codes):
            pending = np.concatenate([[k], pending])  # the k-th place has no longer n-gram
        if not len(pending):
            continue
        table = model.orders[k]
        at = find(table.keys, chain[k][pending - k])
        hit = at >= 0
        out[pending[hit]] += table.logp[at[hit]]
        pending = pending[~hit]
        if k == 0:
            out[pending] += model.floor
        elif len(pending):
            context = find(table.contexts, chain[k - 1][pending - k])
            known = context >= 0
            out[pending[known]] += table.backoff[context[known]]
    return out


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of rows starts[i]:ends[i]."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[ends] - total[starts]
