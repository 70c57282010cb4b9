"""Near-duplicate removal: SimHash, BK-trees over shards, exact similarity of word shingles.

Texts are sets of five-word shingles, and two are linked when their sets have a similarity (Jaccard) of 0.8
or more. Such pairs differ in about ten of 64 fingerprint bits, too many for shards by
bit blocks. So fingerprints are filed by MinHash bands instead: a pair at 0.8 shares one of BANDS bands of
ROWS minima with probability 1 - (1 - 0.8**4)**20 > 0.9999. Each shard has a BK-tree, searched within
RADIUS bits, and returns the links of a spanning forest. By binomial tails over 64 independent bits a pair at 0.8 is
further apart with probability 7e-6 at most; only 4 against 5 shingles differ more (1e-4), so sets of up to SMALL
shingles are filed a second time and searched within SMALL_RADIUS bits (1e-6). With the bands (3e-5) a pair at 0.8 is
missed with probability 4e-5 at most, and more similar ones less. The components are candidates only:
inside one all pairs of texts not yet joined are compared exactly, whatever their bits, and the
components of the exact links are the groups.

Texts with equal shingle sets are one member, known by a 64-bit hash of the set. A component of over
CHUNK_ROWS members or CHUNK_BYTES bytes is dealt into chunks, and each pair of chunks is a task group, so that
no task holds a component and no pair is lost.

Words end at ASCII white space, A-Z are lower-cased; fewer than five words are one shingle.

Defined cases: null, empty and wordless texts have equal (empty) sets and so are one group; of a group the row of
least id stays, null ids come last, equal ids go by a hash of the text, and of repeated rows one stays;
an empty table gives an empty result; further columns are carried along untouched.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, lean_batches, pack, possible
from .components import components
from .simhash import SHARD_CAP, majority, search_shards

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILAR = (4, 5)
BANDS, ROWS = 20, 4
RADIUS = 24
SMALL, SMALL_RADIUS = 8, 28
CHUNK_ROWS = 4096
CHUNK_BYTES = 4 << 20
#: Shingles whose minima are taken in one step.
STEP = 1 << 12
MULTIPLY = np.array([xxhash.xxh64_intdigest(b"multiply %d" % i) | 1 for i in range(BANDS * ROWS)], np.uint64)
ADD = np.array([xxhash.xxh64_intdigest(b"add %d" % i) for i in range(BANDS * ROWS)], np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(raw: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words."""
    words = (raw or b"").lower().split()  # on bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(max(len(h) - k + 1, 1), np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ h[j : j + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band of the set's minima; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[at : at + STEP, None] * MULTIPLY + ADD).min(axis=0), out=least)
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = (key ^ least[j::ROWS]) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(k: int = SHINGLE):
    """A UDF from UTF-8 texts to the set's hash, its fingerprint and its band keys, twice those of small sets."""

    @F.pandas_udf("sid long, fp long, keys array<long>")
    def of(raw: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(x, k) for x in raw]
        sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"sid": sid, "fp": fp, "keys": [np.tile(band_keys(s), 2 if len(s) <= SMALL else 1) for s in sets]})

    return of


def exact_links(sid: np.ndarray, sets: list[np.ndarray], fp: np.ndarray, radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all members whose sets are similar, and whose fingerprints are within the radius if one is given.

    Members near the bitwise majority come first: the text that others were made from is then the root of its
    group. A member is compared with the roots first, and after that with the groups that it has not joined.
    """
    near = np.bitwise_count(fp ^ np.uint64(majority(fp)))
    order = np.lexsort((sid, near))
    sid, fp, sets = sid[order], fp[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), np.int64)
    root = np.arange(len(sid))
    up, down = SIMILAR

    def similar(q: int, met: np.ndarray) -> np.ndarray:
        """Those of met that share enough with the marked member q."""
        n = size[met]
        first = np.cumsum(n) - n
        both = np.add.reduceat(mark[ids[np.repeat(start[met] - first, n) + np.arange(n.sum())]], first) if len(met) else n
        return met[down * both >= up * (n + size[q] - both)]

    for q in range(1, len(sid)):
        small, large = np.minimum(size[:q], size[q]), np.maximum(size[:q], size[q])
        can = (down * small >= up * large) & (size[:q] > 0)
        if radius is not None:
            can &= np.bitwise_count(fp[:q] ^ fp[q]) <= radius
        met = np.flatnonzero(can)
        if not len(met):
            continue
        own = ids[start[q] : start[q] + size[q]]
        mark[own] = 1
        joined = similar(q, met[root[met] == met])
        rest = met[(root[met] != met) & ~np.isin(root[met], joined)]
        joined = np.union1d(joined, root[similar(q, rest)])
        mark[own] = 0
        if len(joined):
            root[q] = joined[0]
            root[:q][np.isin(root[:q], joined[1:])] = joined[0]
    moved = np.flatnonzero(root != np.arange(len(sid)))
    return sid[moved], sid[root[moved]]


def _compare(k: int):
    """Arrow batches (root, i, j, sid, fp, text), sorted by the first three, to exact links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(members: dict) -> pa.RecordBatch:
            sid = np.array(list(members), np.int64)
            fp = np.array([f for f, _ in members.values()], np.int64).view(np.uint64)
            a, b = exact_links(sid, [s for _, s in members.values()], fp)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        group, members = None, {}
        for batch in batches:
            for *key, sid, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    if len(members) > 1:
                        yield flush(members)
                    group, members = key, {}
                members[sid] = (fp, shingle_set(text, k))
        if len(members) > 1:
            yield flush(members)

    return run


def candidates(named: DataFrame, cap: int = SHARD_CAP) -> DataFrame:
    """From (fp, keys) the rows (node, root) of all fingerprints that share a shard within the radius.

    All rows are dealt by shard once; only the shards of over cap rows, one for every cap rows at most, are met by a join.
    """
    filed = named.select("fp", F.posexplode("keys").alias("t", "k"))
    hot = cut(filed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > cap))
    hot = hot.select(F.col("t").alias("ht"), F.col("k").alias("hk"), F.ceil(F.col("n") / F.lit(cap)).cast("long").alias("chunks"))
    met = filed.join(hot, (F.col("t") == F.col("ht")) & (F.col("k") == F.col("hk")), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    dealt = met.select("t", "k", F.explode(chunk_pairs(F.xxhash64("fp"))).alias("g"), "fp").select("t", "k", "g.i", "g.j", "fp")

    def search(rows: DataFrame, radius: int) -> DataFrame:
        return rows.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp").mapInArrow(search_shards(radius), "a long, b long")

    return components(search(dealt.where(F.col("t") < BANDS), RADIUS).union(search(dealt.where(F.col("t") >= BANDS), SMALL_RADIUS)))


def chunk_pairs(number: Column) -> Column:
    """The pairs (i, j) of chunks that a member meets the others of its group in; column `chunks` has their count."""
    own = F.pmod(number, F.col("chunks"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One document of each group, columns as they came."""
    lean_batches(docs.sparkSession)
    rows = pack(docs)
    body = F.coalesce(F.col("row")[text], F.lit("")).cast("binary")
    key = [F.col("row")[doc_id].isNull().alias("none"), F.coalesce(F.col("row")[doc_id], F.lit(0)).alias("id"), F.xxhash64(body).alias("hash")]
    ident = F.struct(*key, F.octet_length(body).cast("long").alias("bytes"))
    sigs = cut(rows.select(ident.alias("ident"), sketches(k)(body).alias("s")).select("ident", "s.*"))
    named = cut(sigs.groupBy("sid").agg(F.min("ident").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    near = candidates(named)
    rooted = named.join(near.withColumnRenamed("node", "f"), F.col("fp") == F.col("f"), "left").select("sid", "fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    size = rooted.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("texts"), F.sum("least.bytes").alias("m")).where("texts > 1")
    chunks = F.greatest(F.ceil(F.col("texts") / F.lit(chunk_rows)), F.ceil(F.col("m") / F.lit(chunk_bytes)), F.lit(1)).cast("long")
    spread = hot_join(rooted, size.select("r", "texts", chunks.alias("chunks")), [("root", "r")], "texts", rooted.count())
    members = cut(spread.select("least.none", "least.id", "least.hash", "sid", "fp", "root", "chunks"))
    names = ["none", "id", "hash"]
    own = possible(rows.select(*key, body.alias("t")), members, names).groupBy(*names).agg(F.first("t").alias("t"))  # repeated rows collapse before they move
    texts = own.join(members, names)
    dealt = texts.select("root", F.explode(chunk_pairs(F.xxhash64("sid"))).alias("g"), "sid", "fp", "t").select("root", "g.i", "g.j", "sid", "fp", "t")
    found = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_compare(k), "a long, b long")
    return winners(rows, key, sigs.select("ident", "sid"), rooted.select("sid", "least", "n"), components(found))


def winners(rows: DataFrame, key: list[Column], sigs: DataFrame, named: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose ident is the least of their group, and of rows with equal idents one.

    The idents that go, or that are repeated, are fewer than those that stay: they are written, and of the rows only
    those that may be among them move.
    """
    placed = cut(named.join(groups.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "least", "n"))
    held = placed.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    won = placed.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("won"), F.count("*").alias("texts"))
    best = hot_join(placed, won, [("root", "r")], "texts", held["texts"]).select(F.col("sid").alias("s"), "won", "n")
    gone = hot_join(sigs, best, [("sid", "s")], "n", held["rows"]).where("ident <> won").select("ident")
    again = sigs.groupBy("ident").agg(F.count("*").alias("n")).where("n > 1")
    names = ["none", "id", "hash"]
    both = gone.select("ident", F.lit(1).alias("goes"), F.lit(1).cast("long").alias("n")).union(again.select("ident", F.lit(0), "n"))
    noted = both.groupBy("ident").agg(F.max("goes").alias("goes"), F.sum("n").alias("n"))
    noted = cut(noted.select("ident.none", "ident.id", "ident.hash", "goes", "n"))
    here = rows.select("row", *key)
    side = noted.select(*[F.col(c).alias(f"_{c}") for c in names], "goes", "n")
    near = hot_join(possible(here, noted, names), side, [(c, f"_{c}") for c in names], "n", held["rows"], unmatched=True)
    alone = near.where("goes is null").select("row")
    first = near.where("goes = 0").groupBy(*names).agg(F.first("row").alias("row")).select("row")
    return possible(here, noted, names, found=False).select("row").union(alone).union(first).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; columns as they came."""
    return near_dedup(docs)
