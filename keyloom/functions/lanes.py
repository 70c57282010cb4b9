"""The hash families over many tokens at once, for rows of tokens: what hashing.py says of a token, in NumPy.

A row's key is made where the row is, without a shuffle: a batch's distinct tokens are hashed once. Tokens of plain ASCII up to
WIDE bytes go through arrays, the few others one by one. tests/test_discovery.py holds each against its column form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

from . import hashing

if TYPE_CHECKING:
    from .hashing import HashFamily

WIDE = 24
#: Tokens of an array step.
STEP = 4096

U = np.uint64


def _bytes(tokens: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the tokens' bytes, padded with zeros, and their lengths."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    mat = np.array(tokens, f"S{width}").view(np.uint8).reshape(len(tokens), width)
    return mat, size


def _set(out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
    """Sets bit at[i] in row rows[i]; a row occurs once."""
    out[rows, at >> 6] |= U(1) << (at & 63).astype(U)


def _charfeat_one(token: str, fam: HashFamily) -> set[int]:
    f = {"chars": True, "location": True, "length": True, "rotation": True} | dict(fam.flags)
    seg = hashing.SEGMENTS[fam.bits]
    area, n, out = len(hashing.ALPHABET) * seg, len(token), set()
    rest = fam.bits - area
    turn = area * (n % rest) // rest if f["rotation"] else 0
    for cnt, c in sorted((token.count(c), c) for c in set(token))[: fam.ones] if f["chars"] else ():
        if c in hashing.ALPHABET:
            s = sum(i for i, x in enumerate(token) if x == c)
            part = (s * seg - 1) // (n * cnt) if s and f["location"] else 0
            out.add((hashing.ALPHABET.index(c) * seg + part + turn) % area)
    return out | {area + n % rest} if f["length"] else out


def _charfeat(tokens: list[bytes], fam: HashFamily) -> np.ndarray:
    f = {"chars": True, "location": True, "length": True, "rotation": True} | dict(fam.flags)
    seg = hashing.SEGMENTS[fam.bits]
    area = len(hashing.ALPHABET) * seg
    rest = fam.bits - area
    width = max(1, max(map(len, tokens)))
    mat, n = _bytes(tokens, width)
    out, every = np.zeros((len(tokens), fam.bits // 64), U), np.arange(len(tokens))
    if f["length"]:
        _set(out, every, area + n % rest)
    if not f["chars"]:
        return out
    place, known = np.arange(width), np.full(256, -1)
    known[np.frombuffer(hashing.ALPHABET.encode(), np.uint8)] = np.arange(len(hashing.ALPHABET))
    same = mat[:, :, None] == mat[:, None, :]
    same &= (place < n[:, None])[:, None, :]
    count, total = same.sum(2), (same * place).sum(2)
    first = (same.argmax(2) == place) & (place < n[:, None])
    rank = np.where(first, (count * 256 + mat) * width + place, np.iinfo(np.int64).max)
    rank.sort(1)
    turn = area * (n % rest) // rest if f["rotation"] else np.zeros_like(n)
    for col in rank[:, : fam.ones].T:
        i = np.flatnonzero(col != np.iinfo(np.int64).max)
        j = col[i] % width
        symbol = known[mat[i, j]]
        i, j, symbol = i[symbol >= 0], j[symbol >= 0], symbol[symbol >= 0]
        s = total[i, j]
        part = np.where(s > 0, (s * seg - 1) // (n[i] * count[i, j]), 0) if f["location"] else 0
        _set(out, i, (symbol * seg + part + turn[i]) % area)
    return out


def _of_positions(found: list[set[int]], bits: int) -> np.ndarray:
    out = np.zeros((len(found), bits // 64), U)
    for row, positions in zip(out, found, strict=True):
        for p in positions:
            row[p >> 6] |= U(1 << (p & 63))
    return out


def _plain(tokens: list[bytes], width: int, arrays: Callable, one: Callable, fam: HashFamily) -> np.ndarray:
    """arrays() over plain tokens in steps, one() over the others' texts."""
    out = np.zeros((len(tokens), fam.bits // 64), U)
    fits = np.fromiter((len(t) <= width and t.isascii() and b"\0" not in t for t in tokens), bool, len(tokens))
    short, rest = np.flatnonzero(fits), np.flatnonzero(~fits)
    for i in range(0, len(short), STEP):
        own = short[i : i + STEP]
        out[own] = arrays([tokens[k] for k in own], fam)
    if len(rest):
        out[rest] = one([tokens[k].decode() for k in rest], fam)
    return out


def charfeat(tokens: list[bytes], fam: HashFamily) -> np.ndarray:
    return _plain(tokens, WIDE, _charfeat, lambda ts, f: _of_positions([_charfeat_one(t, f) for t in ts], f.bits), fam)


def _md5(tokens: list[bytes], bits: int) -> np.ndarray:
    parts = []
    for k in range(max(1, bits // 128)):
        salt = b"" if k == 0 else b"\x00%d" % k
        parts.append(np.frombuffer(b"".join([hashlib.md5(t + salt, usedforsecurity=False).digest() for t in tokens]), ">u8").reshape(-1, 2)[:, ::-1])
    return np.concatenate(parts, 1)[:, : bits // 64].astype(U)


def md5(tokens: list[bytes], fam: HashFamily) -> np.ndarray:
    return _md5(tokens, fam.bits)


def simhash(tokens: list[bytes], fam: HashFamily) -> np.ndarray:
    seen: dict[str, int] = {}
    pieces, starts = [], []
    for t in tokens:
        t = re.sub(r"[^a-zA-Z_0-9]+", "", t.decode().lower())
        starts.append(len(pieces))
        pieces += [seen.setdefault(t[i : i + 3], len(seen)) for i in range(max(len(t) - 3, 0) + 1)]
    lanes = _md5([p.encode() for p in seen], fam.bits)
    votes = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(seen), -1), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    out, starts = np.zeros((len(tokens), fam.bits // 64), U), np.array(starts)
    for i in range(0, len(tokens), STEP):
        end = starts[i + STEP] if i + STEP < len(tokens) else len(pieces)
        own = np.add.reduceat(votes[pieces[starts[i] : end]], starts[i : i + STEP] - starts[i])
        out[i : i + STEP] = np.packbits(own > 0, axis=1, bitorder="little").view("<u8")
    return out


def _murmur_128(tokens: list[bytes], seed: int) -> np.ndarray:
    """(low, high) of tokens of up to 15 bytes: all of them tail."""
    mat, n = _bytes(tokens, 16)
    k = mat.view("<u8").astype(U)
    rot = lambda x, r: (x << U(r)) | (x >> U(64 - r))
    c1, c2 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)
    h1 = U(seed) ^ (rot(k[:, 0] * c1, 31) * c2)
    h2 = U(seed) ^ (rot(k[:, 1] * c2, 33) * c1)

    def end(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))

    h1, h2 = h1 ^ n.astype(U), h2 ^ n.astype(U)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = end(h1), end(h2)
    h1 = h1 + h2
    return np.stack([h1, h2 + h1], 1)


def murmur(tokens: list[bytes], fam: HashFamily) -> np.ndarray:
    seeds, lanes = range(max(1, fam.bits // 128)), fam.bits // 64
    arrays = lambda ts, f: np.concatenate([_murmur_128(ts, s) for s in seeds], 1)[:, :lanes]
    one = lambda ts, f: np.array([[x for s in seeds for x in hashing.murmur3_128(t.encode(), s)][:lanes] for t in ts], U)
    return _plain(tokens, 15, arrays, one, fam)


def _murmur_32(tokens: list[bytes], seed: int) -> np.ndarray:
    mat, n = _bytes(tokens, 16)
    words, size = mat.view("<u4").astype(np.uint32), n.astype(np.uint32)
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    mix = lambda k: rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = np.full(len(tokens), seed, np.uint32)
    for i in range(4):
        k = mix(words[:, i])
        h = np.where(n >= 4 * i + 4, rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(n > 4 * i, h ^ k, h))
    h = h ^ size
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def bloom_murmur(tokens: list[bytes], fam: HashFamily) -> np.ndarray:
    def arrays(ts: list[bytes], f: HashFamily) -> np.ndarray:
        out = np.zeros((len(ts), f.bits // 64), U)
        for i in range(f.ones):
            _set(out, np.arange(len(ts)), _murmur_32(ts, i).astype(np.int64) % f.bits)
        return out

    one = lambda ts, f: _of_positions([{hashing.murmur3_32(t.encode(), i) % f.bits for i in range(f.ones)} for t in ts], f.bits)
    return _plain(tokens, 15, arrays, one, fam)


#: Name to lanes (tokens, bits / 64) of many tokens.
MANY: dict[str, Callable[[list[bytes], HashFamily], np.ndarray]] = {"charfeat": charfeat, "md5": md5, "simhash": simhash, "murmur": murmur, "bloom_murmur": bloom_murmur}


def row_lanes(rows: pa.Array, fam: HashFamily) -> pa.Array:
    """Of lists of tokens: the OR of each list's lanes, as a list of signed longs."""
    words = rows.flatten().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    lanes, out = fam.bits // 64, np.zeros((len(rows), fam.bits // 64), U)
    if len(words):
        known = MANY[fam.name](words.dictionary.cast(pa.binary()).to_pylist(), fam)[words.indices.to_numpy()]
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        held = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[held]
        out[held] = np.bitwise_or.reduceat(known, starts)
    ends = pa.array(np.arange(0, out.size + 1, lanes, dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(out.view(np.int64).ravel()))
