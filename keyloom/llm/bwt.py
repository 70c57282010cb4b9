"""Burrows-Wheeler transforms of shards of strings, and their merge by interleave refinement.

A shard is its strings, each followed by a sentinel (symbol 0; byte b is symbol b + 1), read as a
circle. Its suffixes are sorted once, by doubling. The merge never sorts suffixes again: it keeps
which shard the next suffix comes from, and each round deals that interleave stably by the STEP symbols
before each suffix, so that after h rounds it is ordered by the first h * STEP symbols. A boundary
between neighbours that first appears in round h is a common prefix of (h - 1) * STEP symbols at least;
neighbours without a boundary after all rounds share `depth` symbols, and such runs are the repeated intervals.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Symbols of a shard, about.
SHARD = 1 << 14
#: Symbols that a round of the merge goes deeper: two fit 16 bits, which sort by counting.
STEP = 2


def symbols(strings: list[bytes], wide: bool = False) -> np.ndarray:
    """wide: a byte 255 occurs (never in UTF-8), so symbols need 16 bits."""
    flat = np.frombuffer(b"".join(strings), np.uint8)
    flat = flat.astype(np.uint16) + 1 if wide else flat + np.uint8(1)
    ends = np.cumsum([len(s) for s in strings])
    return np.insert(flat, ends, 0)


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Circular suffixes by their first `depth` symbols at least."""
    n, step = len(t), 7
    key = np.zeros(n, np.int64)
    for j in range(step):  # seven symbols below 257 fit a long
        key = key * 257 + np.roll(t, -(j % n))
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        group = np.cumsum(new) - 1
        if step >= depth or group[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = group
        key = rank * n + np.roll(rank, -(step % n))
        step *= 2


def transform(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The STEP symbols before each suffix, in the order of suffixes."""
    out = t[order - STEP].astype(np.uint16 if t.dtype == np.uint8 else np.uint32)
    for j in range(STEP - 1, 0, -1):
        out = out * (256 if t.dtype == np.uint8 else 257) + t[order - j]
    return out


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the concatenated transforms, common prefix with the one before) in merged order.

    Prefixes are known to STEP symbols, from below, and to `depth` (a multiple of STEP) at most.
    """
    bwt = np.concatenate(transforms)
    size = [len(b) for b in transforms]
    kind = np.uint8 if len(size) < 256 else np.uint16 if len(size) < 1 << 16 else np.int64
    z = np.repeat(np.arange(len(size), dtype=kind), size)
    n = len(bwt)
    block = np.zeros(n, np.int32)
    prefix = np.full(n, depth, np.int32)
    prefix[:1] = 0
    edges = 1
    at = np.empty(n, np.int32)
    places = np.arange(n, dtype=np.int32)
    for h in range(STEP, depth + 1, STEP):
        at[np.argsort(z, kind="stable")] = places
        symbol = bwt[at]
        dealt = np.argsort(symbol, kind="stable")
        s, b = symbol[dealt], block[dealt]
        new = np.ones(n, bool)
        new[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        prefix[new & (prefix == depth)] = h - STEP
        nz, now = z[dealt], int(new.sum())
        same = now == edges and np.array_equal(nz, z)
        z, block, edges = nz, np.cumsum(new, dtype=np.int32), now
        if same:
            break
    at[np.argsort(z, kind="stable")] = places
    return at, prefix


def repeated_minima(strings: list[bytes], least: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each string and each start of a run of `depth` bytes in it, the least value of any string with these bytes."""
    length = np.array([len(s) for s in strings])
    shard_of = np.cumsum(length + 1) // SHARD
    bounds = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(shard_of)) + 1, [len(strings)]]))
    transforms, owner, offset = [], [], []
    wide = any(b"\xff" in s for s in strings)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        t = symbols(strings[a:b], wide)
        order = suffix_order(t, depth + STEP)
        transforms.append(transform(t, order))
        start = np.concatenate([[0], np.cumsum(length[a:b] + 1)[:-1]])
        own = np.searchsorted(start, order, "right") - 1
        owner.append(own + a)
        offset.append(order - start[own])
    at, prefix = merge(transforms, depth)
    owner_, offset_ = np.concatenate(owner)[at], np.concatenate(offset)[at]
    first = np.flatnonzero(prefix < depth)
    low = np.minimum.reduceat(least[owner_], first)[np.cumsum(prefix < depth) - 1]
    out = [np.empty(max(0, n - depth + 1), np.int64) for n in length]
    whole = offset_ + depth <= length[owner_]
    base = np.concatenate([[0], np.cumsum(np.maximum(0, length - depth + 1))])
    flat = np.empty(base[-1], np.int64)
    flat[base[owner_[whole]] + offset_[whole]] = low[whole]
    for i in range(len(out)):
        out[i] = flat[base[i] : base[i + 1]]
    return out
