"""SimHash near-duplicates with BK-trees over shards of fingerprints.

Fingerprints of 64 bits are cut into five blocks. Two that differ in at most three bits
agree in two blocks at least, so each is filed under all ten pairs of blocks, and
linked fingerprints meet in a shard: those that agree in the same two blocks. Each shard has a
BK-tree, whose children are keyed by their Hamming distance to the parent; a search follows only
edges within the radius of its own distance. Trees are arrays, built and searched level by
level for all shards of a batch at once.

The trees stay with their shards and queries go there: a broadcast of all trees would grow with the
corpus. A shard of over SHARD_CAP fingerprints is dealt into chunks, and each pair of chunks is a task
group with a tree of its own, so that a hot shard fills no task and no pair is lost. Equal
fingerprints are one node, and a shard returns the links of a spanning forest instead of
all pairs. Components are joined by large-star and small-star steps.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any
others; a text of one or two words is one shingle; components are named by their least non-null
doc_id (null if they have none); repeated rows are repeated in the result; an empty table
gives an empty result; further columns are carried along untouched.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, lean_batches, table
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Bits of the five blocks, low to high.
BLOCKS = (13, 13, 13, 13, 12)
AGREE = len(BLOCKS) - RADIUS
#: Fingerprints of one tree at most.
SHARD_CAP = 1 << 14
#: Fingerprints whose shards are searched in one batch, about.
BATCH = 1 << 16
CHUNK = 1 << 16
#: Visits of nodes that the queries of one search may make, about: some ten arrays of that length.
VISITS = 1 << 20


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    parts = zip(*(words[i:] for i in range(k)), strict=False)
    return np.fromiter((h(b" ".join(p), SEED) for p in parts), np.uint64, len(words) - k + 1)


def fingerprint(raw: bytes | None, k: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    words = (raw or b"").lower().split()  # on bytes: ASCII letters and white space only
    return majority(shingle_hashes(words, k))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    table_ = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), CHUNK):
        by = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        if len(by) < 256:
            ones += table_[by].sum(axis=0)
        else:
            ones += np.stack([np.bincount(by[:, j], minlength=256) for j in range(8)]) @ table_
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits.ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(k: int = SHINGLE):
    @F.pandas_udf("long")
    def of(raw: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, k) for x in raw], np.uint64).view(np.int64))

    return of


class Forest:
    """BK-trees of all groups of a batch. Values of a group are distinct; group is ascending."""

    def __init__(self, group: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value
        self.root = np.searchsorted(group, group, "left")
        active, at = np.flatnonzero(np.arange(n) != self.root), self.root.copy()
        keys, children = [], []
        while len(active):
            d = np.bitwise_count(value[active] ^ value[at[active]]).astype(np.int64)
            key, first, inverse = np.unique(at[active] * 65 + d, return_index=True, return_inverse=True)
            child = active[first]  # active is ascending: the first of each edge becomes the child
            keys.append(key)
            children.append(child)
            at[active] = child[inverse]
            active = active[active != at[active]]
        order = np.argsort(key := np.concatenate(keys or [np.empty(0, np.int64)]))
        self.edge, self.child = key[order], np.concatenate(children or [np.empty(0, np.int64)])[order]

    def near(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of the query's group with node < query, within the radius."""
        found_q, found_n, node = [], [], self.root[query]
        while len(query):
            d = np.bitwise_count(self.value[query] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            found_q.append(query[hit])
            found_n.append(node[hit])
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            query = np.repeat(query, n)
            node = self.child[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.concatenate(found_q), np.concatenate(found_n)


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index reached from each of n nodes."""
    root = np.arange(n)
    for a, b in pairs:
        a, b = root[a], root[b]
        while len(left := np.flatnonzero(a != b)):
            a, b = a[left], b[left]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
            a, b = root[a], root[b]
    return root


def forest_links(group: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all values of a group that are within the radius of each other."""
    forest = Forest(group, value)
    size = np.bincount(forest.root, minlength=len(value))[forest.root]
    step = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 1, VISITS)[1:]) if size.sum() > VISITS else []
    ends = np.unique(np.concatenate([[0], np.asarray(step, np.int64), [len(value)]]))
    root = spanning(len(value), (forest.near(np.arange(a, b), radius) for a, b in zip(ends[:-1], ends[1:], strict=True)))
    moved = np.flatnonzero(root != np.arange(len(value)))
    return value[moved], value[root[moved]]


def search_shards(radius: int):
    """Arrow batches (shard key columns..., fp), sorted by shard, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: list[np.ndarray], fp: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(fp), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            once = new.copy()  # rows are sorted: equal fingerprints of a shard are neighbours
            once[1:] |= fp[1:] != fp[:-1]
            new, fp = new[once], fp[once]
            a, b = forest_links(np.cumsum(new), fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[-1]) < BATCH:
                continue
            same = np.all([k == k[-1] for k in held[:-1]], axis=0)
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield flush([k[:end] for k in held[:-1]], held[-1][:end])
                held = [x[end:] for x in held]
        if held is not None and len(held[-1]):
            yield flush(held[:-1], held[-1])

    return run


def links(fps: DataFrame, radius: int = RADIUS, cap: int = SHARD_CAP) -> DataFrame:
    """From distinct fingerprints `fp` the links (a, b) that span all pairs within the radius."""
    if radius != RADIUS:
        raise ValueError("BLOCKS are cut for a radius of 3")
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    filed = []
    for t, pair in enumerate(combinations(range(len(BLOCKS)), AGREE)):
        mask = sum(((1 << BLOCKS[i]) - 1) << at[i] for i in pair)
        mask -= (mask >> 63) << 64
        filed.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("k")))
    return search_filed(fps.select("fp", F.explode(F.array(*filed)).alias("s")).select("fp", "s.t", "s.k"), radius, cap)


def search_filed(rows: DataFrame, radius: int, cap: int = SHARD_CAP) -> DataFrame:
    """From distinct (fp, t, k) the links (a, b) that span all pairs of a shard (t, k) within the radius."""
    shards = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(cap)).cast("long")
    own = F.pmod(F.xxhash64("fp"), "chunks")
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    filed_in = rows.join(shards, ["t", "k"]).withColumn("chunks", chunks).select("t", "k", F.explode(each).alias("g"), "fp").select("t", "k", "g.i", "g.j", "fp")
    grouped = filed_in.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp")
    return grouped.mapInArrow(search_shards(radius), "a long, b long")


def group_fingerprints(fps: DataFrame) -> DataFrame:
    """From distinct `fp` the rows (node, root) of all that have a link."""
    return components(links(fps))


def op1_bk_tree_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sigs = cut(docs.select("doc_id", fingerprints()(F.col("text").cast("binary")).alias("fp")))
    named = cut(sigs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = group_fingerprints(named.select("fp"))
    met = linked.join(named, linked["node"] == named["fp"]).select("fp", "root", "least")
    named_roots = met.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")).withColumnRenamed("root", "_root")
    label = hot_join(met, named_roots, [("root", "_root")], "members", linked.count()).select(F.col("fp").alias("f"), "component_id")
    label = cut(named.join(label, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("_fp"), "n", F.coalesce("component_id", "least").alias("component_id")))
    total = label.agg(F.sum("n").alias("n")).first()["n"] or 0
    return hot_join(sigs, label, [("fp", "_fp")], "n", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
