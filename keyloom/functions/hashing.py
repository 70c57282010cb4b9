"""Hash families: a token to the bits that it sets in a row's super key.

A family gives lanes: bits / 64 signed longs. The row key is the bitwise OR of its tokens' lanes,
and a query row can only match a lake row whose key holds all of its bits. Any
family is right for that filter; families differ in how many false candidates pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lanes
from .text import shingles

#: Symbols of the character-feature hash, and segments per symbol by size.
ALPHABET = " 0123456789abcdefghijklmnopqrstuvwxyz"
SEGMENTS = {64: 1, 128: 3, 256: 6, 512: 13}


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def lanes_of(positions: Column, bits: int) -> list[Column]:
    """Bit positions (array<int>) to lanes."""

    def lane(k: int) -> Column:
        own = F.filter(positions, lambda p: _div(p, 64) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))

    return [lane(k) for k in range(bits // 64)]


def contains(row: list[Column], query: list[Column]) -> Column:
    """All query bits are row bits."""
    out = F.lit(True)
    for r, q in zip(row, query, strict=True):
        out = out & (r.bitwiseAND(q) == q)
    return out


def charfeat_positions(token: Column, bits: int = 128, ones: int = 5, chars: bool = True, location: bool = True, length: bool = True, rotation: bool = True) -> Column:
    """Bit positions of the character-feature hash.

    The `ones` rarest characters of the token (count, then character) set one bit each: the symbol's
    index times the segments, plus the segment of the character's mean position. The bits turn
    by an amount from the token's length, which also sets a bit of its own. Features can be
    switched off for ablation.
    """
    seg = SEGMENTS[bits]
    area = len(ALPHABET) * seg
    rest = bits - area
    n = F.length(token)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(token, i, F.lit(1)))

    def feature(c: Column) -> Column:
        at = F.transform(each, lambda x, i: F.when(x == c, i))
        own = F.filter(at, lambda i: i.isNotNull())
        return F.struct(F.size(own).alias("n"), c.alias("c"), F.aggregate(own, F.lit(0), lambda a, i: a + i).alias("s"))

    picked = F.slice(F.array_sort(F.transform(F.array_distinct(each), feature)), 1, ones)

    def bit(f: Column) -> Column:
        part = F.when((f["s"] == 0) | F.lit(not location), F.lit(0)).otherwise(_div(f["s"] * seg - 1, n * f["n"]))
        at = (F.instr(F.lit(ALPHABET), f["c"]) - 1) * seg + part
        turn = _div(F.lit(area) * (n % rest), rest) if rotation else F.lit(0)
        return ((at + turn) % area).cast("int")

    known = F.filter(picked, lambda f: (n > 0) & (F.instr(F.lit(ALPHABET), f["c"]) > 0))
    out = F.transform(known, bit) if chars else F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.concat(out, F.array((area + n % rest).cast("int"))))) if length else F.array_sort(F.array_distinct(out))


def md5_lanes(token: Column, bits: int = 128) -> list[Column]:
    """md5 as two lanes, low half first; further lanes from salted tokens."""
    out = []
    for k in range(max(1, bits // 128)):
        h = F.md5((token if k == 0 else F.concat(token, F.lit(f"\x00{k}"))).cast("binary"))
        out += [F.conv(F.substring(h, at, 16), 16, -10).cast("long") for at in (17, 1)]
    return out[: bits // 64]


def simhash_pieces(token: Column, bits: int = 128) -> Column:
    """The lanes of each 3-character piece of a token, hashed by md5."""
    return F.transform(shingles(token), lambda p: F.array(*md5_lanes(p, bits)))


def simhash_lanes(pieces: Column, bits: int = 128) -> list[Column]:
    """Sign of the summed feature bits."""

    def lane(k: int) -> Column:
        def one(j: Column) -> Column:
            bit = lambda h: F.call_function("shiftright", h[k], j).bitwiseAND(F.lit(1).cast("long"))
            total = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, h: a + 2 * bit(h) - 1)
            return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), one), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return [lane(k) for k in range(bits // 64)]


def xx_lanes(token: Column, bits: int = 128) -> list[Column]:
    """Seeded 64-bit hashes."""
    return [F.xxhash64(token)] + [F.xxhash64(F.lit(k), token) for k in range(1, bits // 64)]


def bloom_positions(token: Column, bits: int = 128, hashes: int = 3) -> Column:
    return F.array_sort(F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(i), token), F.lit(bits)).cast("int") for i in range(hashes)])))


def bloom_size(items: int, rate: float) -> int:
    """Bits of a Bloom filter for so many items at a false-positive rate."""
    return int(-(items * math.log(rate)) / math.log(2) ** 2)


def bloom_hashes(bits: int, items: int) -> int:
    """The best number of hashes of a Bloom filter."""
    return int(bits / items * math.log(2))


M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86, 32 bits."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & M32
    mix = lambda k: rot(k * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & M32
    if tail := data[whole:]:
        h ^= mix(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & M32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & M32
    return h ^ (h >> 16)


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 x64, 128 bits, as (low, high) words."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & M64
    mix1 = lambda k: rot(k * c1 & M64, 31) * c2 & M64
    mix2 = lambda k: rot(k * c2 & M64, 33) * c1 & M64
    h1 = h2 = seed
    whole = len(data) & ~15
    for i in range(0, whole, 16):
        h1 = ((rot(h1 ^ mix1(int.from_bytes(data[i : i + 8], "little")), 27) + h2) * 5 + 0x52DCE729) & M64
        h2 = ((rot(h2 ^ mix2(int.from_bytes(data[i + 8 : i + 16], "little")), 31) + h1) * 5 + 0x38495AB5) & M64
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= mix2(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= mix1(int.from_bytes(tail[:8], "little"))

    def end(k: int) -> int:
        k = (k ^ (k >> 33)) * 0xFF51AFD7ED558CCD & M64
        k = (k ^ (k >> 33)) * 0xC4CEB9FE1A85EC53 & M64
        return k ^ (k >> 33)

    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & M64
    h2 = (h2 + h1) & M64
    h1, h2 = end(h1), end(h2)
    h1 = (h1 + h2) & M64
    return h1, (h2 + h1) & M64


def murmur_lanes(token: Column, bits: int = 128) -> Column:
    """Exact MurmurHash3 as an array of lanes; no built-in has it, so an Arrow UDF runs over the distinct tokens."""

    @F.pandas_udf("array<long>")
    def lanes(tokens: pd.Series) -> pd.Series:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return tokens.map(lambda t: None if t is None else [signed(x) for k in range(max(1, bits // 128)) for x in murmur3_128(t.encode(), k)])

    return lanes(token)


def murmur_bloom_positions(token: Column, bits: int = 128, hashes: int = 3) -> Column:
    """Bloom bits from murmur3_32 with seeds 0, 1, ..."""

    @F.pandas_udf("array<int>")
    def positions(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None else sorted({murmur3_32(t.encode(), i) % bits for i in range(hashes)}))

    return positions(token)


@dataclass(frozen=True)
class HashFamily:
    """A named family with its parameters; query and index must agree on all of them."""

    name: str = "charfeat"
    bits: int = 128
    ones: int = 5
    flags: tuple[tuple[str, bool], ...] = field(default=())

    def attach(self, df: DataFrame, column: str, prefix: str = "") -> DataFrame:
        """df with the lanes of a column's tokens, named prefix + sk0, ...

        What all lanes share (bit positions, pieces) is a column of its own first: several lanes read it, so
        the optimizer computes it once and not inside their lambdas.
        """
        if self.bits not in SEGMENTS:
            raise ValueError(f"bits must be one of {sorted(SEGMENTS)}")
        if self.name not in FAMILIES:
            raise ValueError(f"no hash family {self.name}")
        build, finish = FAMILIES[self.name]
        df = df.withColumn("_shared", build(F.col(column), self))
        lanes = finish(F.col("_shared"), self.bits)
        kept = [c for c in df.columns if c != "_shared"]
        return df.select(*kept, *[x.alias(prefix + c) for c, x in zip(self.columns, lanes, strict=True)])

    @property
    def by_rows(self) -> bool:
        """Whether row_lanes() has this family; a hash of one's own goes through attach()."""
        return self.name in DIRECT or self.name in lanes.MANY

    def row_lanes(self, tokens: Column) -> Column:
        """The lanes of a row as an array, from the array of its tokens: where the row is, with no shuffle."""
        if self.bits not in SEGMENTS:
            raise ValueError(f"bits must be one of {sorted(SEGMENTS)}")
        if self.name in DIRECT:
            one = lambda k: F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(DIRECT[self.name](t, self, k)))
            return F.array(*[one(k) for k in range(self.bits // 64)])
        fam = self

        @F.arrow_udf("array<long>")
        def many(rows: pa.Array) -> pa.Array:
            return lanes.row_lanes(rows, fam)

        return many(tokens)

    @property
    def columns(self) -> list[str]:
        return [f"sk{k}" for k in range(self.bits // 64)]

    def with_bits(self, bits: int) -> HashFamily:
        return replace(self, bits=bits)


def given_lanes(lanes: Column, bits: int) -> list[Column]:
    return [lanes[k] for k in range(bits // 64)]


#: Name to what makes the shared column of a token (array<int> of bit positions, or array<long> of lanes) and what makes lanes of it.
FAMILIES: dict[str, tuple[Callable[[Column, HashFamily], Column], Callable[[Column, int], list[Column]]]] = {
    "charfeat": (lambda t, f: charfeat_positions(t, f.bits, f.ones, **dict(f.flags)), lanes_of),
    "bloom": (lambda t, f: bloom_positions(t, f.bits, f.ones), lanes_of),
    "bloom_murmur": (lambda t, f: murmur_bloom_positions(t, f.bits, f.ones), lanes_of),
    "simhash": (lambda t, f: simhash_pieces(t, f.bits), simhash_lanes),
    "md5": (lambda t, f: F.array(*md5_lanes(t, f.bits)), given_lanes),
    "xx": (lambda t, f: F.array(*xx_lanes(t, f.bits)), given_lanes),
    "murmur": (lambda t, f: murmur_lanes(t, f.bits), given_lanes),
}


def _bloom_lane(token: Column, fam: HashFamily, k: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(fam.ones):
        at = F.pmod(F.xxhash64(F.lit(i), token), F.lit(fam.bits)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)
        out = out.bitwiseOR(F.when(_div(at, 64) == k, bit).otherwise(F.lit(0).cast("long")))
    return out


#: Families whose lanes are a cheap expression: name to lane k of a token.
DIRECT: dict[str, Callable[[Column, HashFamily, int], Column]] = {
    "xx": lambda t, f, k: xx_lanes(t, f.bits)[k],
    "bloom": _bloom_lane,
}


def register_family(name: str, build: Callable[[Column, HashFamily], Column], positions: bool = False) -> None:
    """A hash of one's own: build(token, family) gives bits / 64 lanes, or (positions=True) bit positions below bits.

    Any function of the token alone is right for the filter. A known name is refused.
    """
    if name in FAMILIES:
        raise ValueError(f"there is a hash family {name}")
    FAMILIES[name] = (build, lanes_of if positions else given_lanes)


def family(name: str, bits: int = 128, ones: int | None = None, **flags: bool) -> HashFamily:
    """charfeat, bloom, bloom_murmur, md5, simhash, xx or murmur; ones -1 gives Bloom its best number for six items."""
    if ones is None:
        ones = 5 if name == "charfeat" else 3
    if ones == -1:
        ones = bloom_hashes(bits, 6)
    return HashFamily(name, bits, ones, tuple(sorted(flags.items())))
