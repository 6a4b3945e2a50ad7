"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are classified from right to left; those that start a run of smaller ones (leftmost-smaller) cut the string into
substrings, which are named in order by an induced sort of their own. If names repeat, the string of names is
sorted by the same procedure, and the whole array is induced from its order: one sweep over the
buckets upwards for the larger type, one downwards for the smaller. Within a bucket the sweep works in waves, so that each step is
an array operation. Once names are too many for sweeps to pay, ranks of doubled spans sort them instead.
"""

from __future__ import annotations

import numpy as np

#: A string of names is swept by buckets only while it has this many symbols for each name.
SWEEP = 256


def smaller_type(text: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the next one; the string ends in a unique least symbol."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    following = np.full(n, n - 1, "i4")
    following[differs] = differs
    following[:-1] = np.minimum.accumulate(following[:-1][::-1])[::-1]
    after = np.minimum(following + 1, n - 1)
    out = text < text[after]
    out[n - 1] = True
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys, kind="stable")


def induce(text: np.ndarray, smaller: np.ndarray, names: int, seeds: np.ndarray) -> np.ndarray:
    """The array of all suffixes from an order of the leftmost-smaller ones."""
    n = len(text)
    counts = np.bincount(text, minlength=names)
    starts = np.concatenate([[0], np.cumsum(counts)])
    small = text.astype("u2") if names < 1 << 16 else text  # 16-bit keys are sorted by radix
    out = np.full(n, -1, "i4")
    keys = small[seeds]
    per = np.bincount(keys, minlength=names)
    held = np.cumsum(np.concatenate([[0], per]))
    seeds = seeds[_order(keys)]
    heads = starts[:-1].copy()
    used = np.flatnonzero(counts)

    def deal(items: np.ndarray, at: np.ndarray, step: int) -> None:
        """Append items, in order, to the buckets of their symbols."""
        keys = small[items]
        order = _order(keys)
        items, keys = items[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        inner = np.arange(len(keys)) - np.repeat(first, sizes)
        buckets = keys[first].astype("i8")
        if step > 0:
            out[np.repeat(at[buckets], sizes) + inner] = items
            at[buckets] += sizes
        else:
            out[np.repeat(at[buckets], sizes) - 1 - inner] = items
            at[buckets] -= sizes

    larger = ~smaller
    for c in used:
        done = starts[c]
        while done < heads[c]:
            wave = out[done : heads[c]]
            done = heads[c]
            before = wave[wave > 0] - 1
            before = before[larger[before]]
            if len(before):
                deal(before, heads, 1)
        lms = seeds[held[c] : held[c + 1]]
        before = lms[lms > 0] - 1
        if len(before):
            deal(before[larger[before]], heads, 1) if larger[before].any() else None
    tails = starts[1:].copy()
    floor = heads  # where the larger type ends in each bucket
    for c in used[::-1]:
        done = starts[c + 1]
        while done > tails[c]:
            wave = out[tails[c] : done][::-1]
            done = tails[c]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                deal(before, tails, -1)
        wave = out[starts[c] : floor[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            deal(before, tails, -1)
    out[0] = n - 1  # the end mark
    return out


def _rank_doubling(names: np.ndarray, limit: int) -> np.ndarray:
    """An order of suffixes by their first `limit` symbols at least."""
    rank, span, n = names.astype("i8"), 1, len(names)
    while True:
        order = _order(rank)
        if span >= limit or span >= n:
            return order
        ahead = np.zeros(n, "i8")
        ahead[: n - span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank[order] = fresh
        span *= 2
        if fresh[-1] == n - 1:
            return order


def suffix_array(text: np.ndarray, names: int, limit: int = 1 << 60) -> np.ndarray:
    """Suffixes in order; `text` ends in a unique 0. Order beyond the first `limit` symbols may be left open."""
    n = len(text)
    if n == 1:
        return np.zeros(1, "i4")
    smaller = smaller_type(text)
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(starts) <= 1:
        return induce(text, smaller, names, starts)
    order = induce(text, smaller, names, starts)
    lms = np.zeros(n, bool)
    lms[starts] = True
    ordered = order[lms[order]]
    where = np.zeros(n, "i4")
    where[starts] = np.arange(len(starts))
    length = np.diff(np.append(starts, n - 1)) + 1
    size = length[where[ordered]]
    fresh = np.concatenate([[True], size[1:] != size[:-1]])
    alike = np.flatnonzero(~fresh)
    offset = 0
    while len(alike):
        a, b = ordered[alike] + offset, ordered[alike - 1] + offset
        same = text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
        fresh[alike[~same]] = True
        alike = alike[same]
        offset += 1
        alike = alike[size[alike] > offset]
    named = np.empty(len(starts), "i8")
    named[where[ordered]] = np.cumsum(fresh) - 1
    total = int(named.max()) + 1
    if total == len(starts):
        seeds = ordered
    else:
        shorter = limit // 2 + 2  # each name stands for two symbols or more
        below = suffix_array(named, total, shorter) if total * SWEEP <= len(named) else _rank_doubling(named, shorter)
        seeds = starts[below]
    return induce(text, smaller, names, seeds)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each position the common prefix, up to `limit`, with the suffix before it in order.

    Where the symbols before both differ the value is compared afresh; elsewhere it is that of the position before, less one.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, "i4")
    before = np.full(n, -1, "i4")
    before[order[1:]] = order[:-1]
    here = np.arange(n, dtype="i4")
    kept = (before > 0) & (here > 0) & (text[here - 1] == text[before - 1]) & (before[here - 1] == before - 1)
    fresh = np.flatnonzero(~kept & (before >= 0))
    value = np.zeros(n, "i4")
    padded = np.concatenate([text, np.zeros(limit + 8, text.dtype)])
    alive, offset = fresh, 0
    while len(alive) and offset < limit:
        same = padded[alive + offset] == padded[before[alive] + offset]
        alive = alive[same]
        value[alive] += 1
        offset += 1
    anchor = np.maximum.accumulate(np.where(kept, -1, here))
    # A value cut off at the limit may not be lowered for those that follow: they are compared from what is sure.
    out = np.where(kept, value[anchor] - (here - anchor), value)
    cut = np.flatnonzero(kept & (value[anchor] >= limit))
    if len(cut):
        out[cut] = _extend(padded, cut, before[cut], np.maximum(out[cut], 0), limit)
    return np.maximum(out, 0)


def _extend(padded: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, limit: int) -> np.ndarray:
    value = known.astype("i4").copy()
    alive = np.flatnonzero(value < limit)
    while len(alive):
        same = padded[a[alive] + value[alive]] == padded[b[alive] + value[alive]]
        alive = alive[same]
        value[alive] += 1
        alive = alive[value[alive] < limit]
    return value
