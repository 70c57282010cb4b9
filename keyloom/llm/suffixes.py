"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte is removed if a 50-byte string over it also starts in a document with a smaller id. The steps:

1. Equal texts (by SHA-256) are one text, with the least id; later copies go as a whole (if they hold a string at all), and
   take no part in what follows.
2. The key of a 50-byte string is the least hash of its 28-byte pieces, so it depends on the string only, and
   neighbouring strings mostly share it. Keys that occur in two documents are found by dealing the keys of all
   texts, packed by batch, to parts; what a batch already knows to be repeated is sent once.
3. Runs of strings with one repeated key are cut out as contexts (at most 72 bytes). Equal contexts are one row
   with the least id (a grouped minimum, so hot passages collapse before they move).
4. Contexts with one key meet in a task. Their shards' transforms are merged by interleave refinement, 50 rounds
   deep, and each interval of strings with 50 common symbols takes its least id. The contexts of a key with over GROUP_CAP
   are dealt to chunks by their hash and merged there; each chunk passes on its distinct strings, which are dealt by their
   own hash and merged once more. A string is there once from each chunk at most, however many contexts hold it.
5. The least ids go back to the contexts' places; runs are united per document and cut out.

No suffix array of the whole corpus is ever in one place: equal strings have equal keys, so the merge of
the shards of a key is complete for them.

Defined cases: null and empty texts have no bytes; documents with a null id neither lose bytes nor
take any; equal ids are not smaller than each other, so repeated rows have equal results; texts under 50 bytes stay; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated_minima
from .common import cut, hot_join, lean_batches, possible, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, PIECE = 50, 28
WIDTH = LENGTH - PIECE + 1
#: Strings of one context at most: a mask of them fits a long.
RUN = WIDTH
#: Contexts of one key that are merged in one task; more are merged in two levels.
GROUP_CAP = 20_000
#: Symbols that are merged at once, about: so few that the arrays of a merge stay in a core's cache.
MERGE = 1 << 17
#: Contexts that are looked at together, about.
SINGLES = 10_000
#: Text bytes whose keys make one part, about, and the fewest parts.
PART_BYTES, MIN_PARTS = 32 << 20, 32
CHUNK = 1 << 22
#: Stands for several documents; no document has this id.
SEVERAL = np.iinfo(np.int64).min
B = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(17)]


def string_keys(raw: bytes) -> np.ndarray:
    """The key of the string that starts at each byte."""
    return keys_and_pieces(raw)[0]


def keys_and_pieces(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of strings, and hashes of pieces, by start."""
    a = np.frombuffer(raw, np.uint8)
    parts = [_keys(a[at : at + CHUNK + LENGTH - 1]) for at in range(0, max(0, len(a) - LENGTH + 1), CHUNK)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([k for k, _ in parts]), np.concatenate([*(x[: len(k)] for k, x in parts[:-1]), parts[-1][1]])


def _keys(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = {1: a.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * B[k] + h[k][k:]
    n = len(a) - PIECE + 1
    x = h[16][:n] * B[12] + h[8][16 : 16 + n] * B[4] + h[4][24:]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    low = x
    for k in (1, 2, 4, 8):
        low = np.minimum(low[:-k], low[k:])
    return np.minimum(low[: len(low) - (WIDTH - 16)], low[WIDTH - 16 :]), x


def _spans(cuts: np.ndarray, end: int) -> list[tuple[int, int]]:
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), end], strict=False))


def key_parts(n_parts: int):
    """(doc_id, text) to rows (part, keys, owners): the distinct keys of each batch by part.

    A key of several documents of the batch is sent as one entry of the owner SEVERAL and once more to its documents, as a row
    of a negative part, which is an answer already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            keys, own = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
            for i, raw in enumerate(batch.column(1).to_pylist()):
                k = string_keys(raw)
                k = np.unique(k[np.concatenate([[True], k[1:] != k[:-1]])])
                keys.append(k)
                own.append(np.full(len(k), i, np.uint32))
            key, owner = np.concatenate(keys), np.concatenate(own)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            twin = np.zeros(len(key), bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:]
            part, packs = [], []
            if twin.any():
                part.append(-1 - int(ids[0] % 1_000_003))
                packs.append((key[twin], owner[twin]))
            once = np.unique(key[twin])
            text = ids[owner[~twin]]
            key = np.concatenate([key[~twin], once])
            text = np.concatenate([text, np.full(len(once), SEVERAL)])
            to = (key % np.uint64(n_parts)).astype(np.int64)
            order = np.lexsort((text, to))  # equal ids side by side compress well
            key, text, to = key[order], text[order], to[order]
            cuts = np.searchsorted(to, np.unique(to), "left")
            rows = [(p, k.tobytes(), ids[o].tobytes()) for p, (k, o) in zip(part, packs, strict=True)]
            rows += [(int(to[a]), key[a:b].tobytes(), text[a:b].tobytes()) for a, b in _spans(cuts, len(to))]
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], ["part", "keys", "owners"])

    return run


def repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts, sorted by part, to (doc_id, keys): the keys of a document that another document has too."""

    def out(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        keep = owner != SEVERAL
        key, owner = key[keep], owner[keep]
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)  # a key goes to a document once
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[new], owner[new]
        names, cuts = np.unique(owner, return_index=True)
        blobs = [key[a:b].tobytes() for a, b in _spans(cuts, len(key))]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "keys"])

    def flush(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in held])
        owner = np.concatenate([np.frombuffer(t, np.int64) for _, t in held])
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        group = np.cumsum(start) - 1
        # repeated: two different documents, or an entry for several documents of a batch
        first = owner[np.flatnonzero(start)]
        odd = first == SEVERAL
        odd[group[owner != first[group]]] = True
        return out(key[odd[group]], owner[odd[group]])

    now, held = None, []
    for batch in batches:
        for part, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part < 0:
                yield out(np.frombuffer(k, np.uint64), np.frombuffer(t, np.int64))
                continue
            if part != now and held:
                yield flush(held)
                held = []
            now = part
            held.append((k, t))
    if held:
        yield flush(held)


CONTEXT = "text_key long, doc_id long, key long, start long, piece int, context binary"
#: A string that two contexts share reaches LENGTH - PIECE bytes beyond the piece, so one of these (before, after) at least.
REACH = ((0, 17), (6, 11), (12, 5), (18, 0))


def single_places(pieces: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where each key stands among pieces[lo:hi], from lo; -1 if more than once."""
    names = np.unique(key)
    place = np.flatnonzero(np.isin(pieces, names))
    n = len(pieces) + 1
    order = np.sort(np.searchsorted(names, pieces[place]) * n + place)
    base = np.searchsorted(names, key) * n
    first = np.searchsorted(order, base + lo)
    more = np.searchsorted(order, base + hi) - first > 1
    return np.where(more, -1, order[first] - base - lo)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, doc_id, text, blobs of keys) to the contexts of the text's repeated keys.

    `piece` is where the piece that gave the key stands in the context, or -1 if it stands there more than once.
    """
    names = ["text_key", "doc_id", "key", "start", "piece", "context"]
    cols: list[list[np.ndarray]] = [[] for _ in names]
    sizes, rows = [], 0

    def out() -> pa.RecordBatch:
        wide = [np.concatenate([np.empty(0, np.int64), *c]) for c in cols[:4]]
        piece, flat = np.concatenate([np.empty(0, np.int32), *cols[4]]).astype(np.int32), np.concatenate([np.empty(0, np.uint8), *cols[5]])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes]))]).astype(np.int32)
        context = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in wide), pa.array(piece, pa.int32()), context], names)

    for batch in batches:
        for name, doc, raw, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, pieces = keys_and_pieces(raw)
            known = np.isin(key, np.frombuffer(b"".join(blobs), np.uint64))
            start = np.flatnonzero(known)
            if not len(start):
                continue
            k = key[start]
            new = np.ones(len(start), bool)
            new[1:] = (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            run = np.diff(np.append(at, len(start)))
            # runs in steps of RUN strings
            steps = -(-run // RUN)
            of = np.repeat(np.arange(len(at)), steps)
            j = (np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)) * RUN
            s, many, own = start[at][of] + j, np.minimum(RUN, run[of] - j), k[at][of]
            long = many + LENGTH - 1
            for c, x in zip(cols[:4], (np.full(len(s), name), np.full(len(s), doc), own.view(np.int64), s), strict=True):
                c.append(x)
            cols[4].append(single_places(pieces, own, s, s + many + WIDTH - 1))
            cols[5].append(np.frombuffer(raw, np.uint8)[np.repeat(s - (np.cumsum(long) - long), long) + np.arange(long.sum())])
            sizes.append(long)
            rows += len(s)
            if rows > 20_000:
                yield out()
                cols, sizes, rows = [[] for _ in names], [], 0
        yield out()
        cols, sizes, rows = [[] for _ in names], [], 0


#: For hashes of windows: powers of an odd number, and of its inverse, modulo 2**64.
ODD = int(B[1])
EVEN_OUT = pow(ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))])


def agreeing(flat: np.ndarray, ends: np.ndarray, piece: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which contexts (flat[ends[i]:ends[i + 1]]) need a merge: they agree with another of their group on one of the REACH pairs.

    Windows are compared by 64-bit hashes: two that clash are merged without need, which changes nothing. A group with a
    piece that stands more than once in a context is merged as a whole.
    """
    size = np.bincount(group)
    shared = (size > 1)[group]
    agree = shared & (np.bincount(group, piece < 0) > 0)[group]
    rest = shared & ~agree
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(ODD, len(flat)), out=total[1:])
    back = _powers(EVEN_OUT, len(flat))
    for before, after in REACH:
        at = np.flatnonzero(rest & (piece >= before) & (np.diff(ends) >= piece + PIECE + after))
        lo = ends[at] + piece[at] - before
        h = (total[lo + before + PIECE + after] - total[lo]) * back[lo]
        h ^= h >> np.uint64(29)
        h += group[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        _, name, n = np.unique(h, return_inverse=True, return_counts=True)
        agree[at[n[name] > 1]] = True
    return agree


def interval_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, context, least, last, piece, n), sorted by key, to (context, n, minima): the least id of each string in the context.

    A string that two contexts share holds the piece, so they agree on one of the REACH pairs around it. A context that agrees
    so with no other of its key shares strings with its own copies only, and needs no merge.
    """

    def out(context: pa.Array, n: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([context, pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))], ["context", "n", "minima"])

    def whole(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """All groups of the rows."""
        key, least, last, piece, n = (np.asarray(rows.column(c)) for c in ("key", "least", "last", "piece", "n"))
        context = rows.column("context")
        ends = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1].astype(np.int64)
        flat = np.frombuffer(context.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        sizes, ends = np.diff(ends) - LENGTH + 1, ends - ends[0]
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        agree = agreeing(flat, ends, piece, group)
        single = np.flatnonzero(~agree & (least < last))
        yield out(context.take(pa.array(single)), n[single], sizes[single], np.repeat(least[single], sizes[single]))
        to_merge = np.flatnonzero(agree)
        first = np.flatnonzero(np.diff(group[to_merge], prepend=-1))  # a group is merged at once
        part = (np.cumsum(sizes[to_merge] + LENGTH)[first] // MERGE) if len(to_merge) else first
        cuts = first[np.flatnonzero(np.diff(part, prepend=-1))]
        for a, b in _spans(cuts, len(to_merge)):
            at = to_merge[a:b]
            held = context.take(pa.array(at))
            yield out(held, n[at], sizes[at], np.concatenate(repeated_minima(held.to_pylist(), least[at], LENGTH)))

    held, n_rows = [], 0
    for batch in batches:
        held.append(batch)
        n_rows += batch.num_rows
        if n_rows < SINGLES or not batch.num_rows:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = np.asarray(rows.column("key"))
        past = np.flatnonzero(key != key[-1])
        if len(past):  # the last group may go on
            yield from whole(rows.slice(0, past[-1] + 1))
            rows = rows.slice(past[-1] + 1)
        held, n_rows = [rows], rows.num_rows
    if n_rows:
        yield from whole(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def string_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, context, least, many), sorted by part, to (context, least, many): each different string of the merged contexts with
    its least id and its occurrences. A context stands for `many` equal ones."""

    def flush(strings: list[bytes], least: list[int], many: list[int]) -> pa.RecordBatch:
        low: dict[bytes, int] = {}
        n: Counter = Counter()
        for c, k, minima in zip(strings, many, repeated_minima(strings, np.array(least, np.int64), LENGTH) if strings else [], strict=True):
            for i, v in enumerate(minima.tolist()):
                low[c[i : i + LENGTH]] = v
                n[c[i : i + LENGTH]] += k
        columns = [pa.array(low, pa.binary()), pa.array(low.values(), pa.int64()), pa.array([n[s] for s in low], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["context", "least", "many"])

    strings, least, many, size, now = [], [], [], 0, None
    for batch in batches:
        for part, context, low, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now and size > MERGE:
                yield flush(strings, least, many)
                strings, least, many, size = [], [], [], 0
            now = part
            strings.append(context)
            least.append(low)
            many.append(k)
            size += len(context) + 1
    yield flush(strings, least, many)


def merged_strings(contexts_: DataFrame, n: int) -> DataFrame:
    """(context, least, many) of each different string of the n contexts (context, least, many), merged in two levels."""
    for seed in (1, 2):
        part = F.pmod(F.xxhash64("context", F.lit(seed)), F.lit(max(1, -(-n // GROUP_CAP)))).alias("part")
        dealt = contexts_.select(part, "context", "least", "many").repartition("part").sortWithinPartitions("part")
        contexts_ = cut(dealt.mapInArrow(string_minima, "context binary, least long, many long"))
        n = contexts_.count()
    return contexts_


def split_minima(contexts_: DataFrame, n: int) -> DataFrame:
    """(context, n, minima) of the n contexts (context, n, least) of keys that are too many for one task."""
    strings = merged_strings(contexts_.select("context", "least", F.lit(1).cast("long").alias("many")), n)
    starts = F.sequence(F.lit(1), F.octet_length("context") - (LENGTH - 1))
    pieces = F.transform(starts, lambda i: F.substring(F.col("context"), i, F.lit(LENGTH)))
    each = contexts_.select("context", "n", F.xxhash64("context").alias("number"), F.posexplode(pieces).alias("at", "string"))
    total = strings.agg(F.sum("many").alias("n")).first()["n"] or 0
    low = strings.select(F.col("context").alias("same"), F.col("least").alias("low"), "many")
    met = hot_join(each, low, [("string", "same")], "many", total, number="number")
    whole = met.groupBy("context").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "low"))).alias("m"))
    return whole.select("context", "n", F.transform("m", lambda x: x["low"]).alias("minima"))


def removal(raw: bytes, hits: np.ndarray) -> tuple[int, int, str]:
    """Bytes removed, runs, and the digest of the rest, from hits: start << RUN | mask of strings."""
    lanes = np.arange(RUN)
    starts = ((hits >> RUN)[:, None] + lanes)[((hits[:, None] >> lanes) & 1).astype(bool)]
    begun = np.zeros(len(raw) + LENGTH, np.int64)
    begun[starts + LENGTH] = 1
    np.cumsum(begun, out=begun)
    gone = np.append(begun[LENGTH:], begun[-1])[: len(raw)] > begun[: len(raw)]
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    lean_batches(spark, 256)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_key"))
    sha = F.unhex(F.sha2("text", 256))
    ident = cut(rows.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha")))
    same = cut(ident.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).withColumnRenamed("sha", "same"))
    total = same.agg(F.sum("n").alias("n")).first()["n"] or 0
    texts, n_bytes = first_copies(rows, sha, ident, same, total)
    n_parts = max(MIN_PARTS, n_bytes // PART_BYTES)
    sent = texts.select("doc_id", "text").mapInArrow(key_parts(n_parts), "part long, keys binary, owners binary")
    answers = sent.repartition("part").sortWithinPartitions("part").mapInArrow(repeated_keys, "doc_id long, keys binary")
    keys = cut(answers.groupBy("doc_id").agg(F.collect_list("keys").alias("keys")))  # no longer than the text: its distinct keys
    met = possible(texts, keys, ["doc_id"]).join(keys, "doc_id")
    places = cut(met.select("text_key", "doc_id", "text", "keys").mapInArrow(contexts, CONTEXT))
    distinct = cut(places.groupBy("key", "context").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.min("piece").alias("piece"), F.count("*").alias("n")))
    hot = cut(distinct.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_CAP))
    n_split = hot.agg(F.sum("n").alias("n")).first()["n"] or 0
    near = distinct.join(hot, "key", "left_anti") if n_split else distinct
    merged = near.select("key", "context", "least", "last", "piece", "n").repartition("key").sortWithinPartitions("key")
    merged = merged.mapInArrow(interval_minima, "context binary, n long, minima array<long>")
    if n_split:
        merged = merged.unionByName(split_minima(distinct.join(hot.select("key"), "key", "left_semi").select("context", "n", "least"), n_split))
    name = lambda a, b: [F.xxhash64("context").alias(a), F.xxhash64("context", F.lit(LENGTH)).alias(b)]
    found = cut(merged.select(*name("f0", "f1"), "n", "minima"))
    many = distinct.agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = F.transform("minima", lambda m, i: F.when(m < F.col("doc_id"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    hits = hot_join(places.select(*name("n0", "n1"), "text_key", "doc_id", "start"), found, [("n0", "f0"), ("n1", "f1")], "n", many)
    hits = hits.select("text_key", "doc_id", "start", mask.alias("mask")).where("mask <> 0")
    hits = cut(hits.groupBy("text_key", "doc_id").agg(F.collect_list(F.call_function("shiftleft", F.col("start"), F.lit(RUN)).bitwiseOR(F.col("mask"))).alias("hits")))

    @F.pandas_udf("n_removed long, n_spans long, sha string")
    def removed(raw: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([removal(r, np.asarray(h, np.int64)) for r, h in zip(raw, found, strict=True)], columns=["n_removed", "n_spans", "sha"])

    done = possible(texts, hits, ["text_key", "doc_id"]).join(hits, ["text_key", "doc_id"]).select(sha.alias("same"), removed("text", "hits").alias("r"))
    side = cut(same.join(done, "same", "left").select("same", "n", "first_id", "r"))
    out = hot_join(ident, side, [("sha", "same")], "n", total)
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    first = F.col("doc_id") == F.col("first_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(first, F.coalesce("r.n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(first, F.coalesce("r.n_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).when(first, F.coalesce("r.sha", F.lower(F.hex("sha")))).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def first_copies(rows: DataFrame, sha: Column, ident: DataFrame, same: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(doc_id, text, text_key) of each different text of LENGTH bytes or more, once, with its least id; and their bytes, about.

    Only texts that are copies or repeated rows, as far as a filter can tell, move.
    """
    long = ident.where((F.col("n_bytes") >= LENGTH) & F.col("doc_id").isNotNull())
    copies = hot_join(long, same, [("sha", "same")], "n", total).where("doc_id > first_id").select("doc_id", "text_key", "sha", F.lit(1).alias("goes"))
    again = long.groupBy("doc_id", "text_key", "sha").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key", "sha", F.lit(0).alias("goes"))
    noted = cut(copies.union(again).groupBy("doc_id", "text_key", "sha").agg(F.max("goes").alias("goes")))
    big = rows.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull())
    near = possible(big, noted, ["doc_id", "text_key"]).withColumn("sha", sha).join(noted.select("doc_id", "sha", "goes"), ["doc_id", "sha"], "left")
    alone = near.where("goes is null").select("doc_id", "text", "text_key")
    first = near.where("goes = 0").groupBy("doc_id", "sha").agg(F.first("text").alias("text"), F.first("text_key").alias("text_key")).select("doc_id", "text", "text_key")
    n_bytes = long.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    return possible(big, noted, ["doc_id", "text_key"], found=False).select("doc_id", "text", "text_key").union(cut(alone.union(first))), n_bytes


def op7_merged_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
c AS MATERIALIZED (SELECT rid, doc_id, o, substr(h, CAST(2 * o + 1 AS INTEGER), 610) AS h FROM (SELECT rid, doc_id, h, unnest(range(0, len(h) // 2 - 49, 256)) AS o FROM d WHERE len(h) >= 100 AND doc_id IS NOT NULL)),
p AS MATERIALIZED (SELECT rid, doc_id, o + i AS i, substr(h, CAST(2 * i + 1 AS INTEGER), 100) AS s FROM (SELECT rid, doc_id, o, h, unnest(range(0, least(256, len(h) // 2 - 49))) AS i FROM c)),
f AS (SELECT s, min(doc_id) AS first_id, max(doc_id) AS last_id FROM p GROUP BY s HAVING first_id < last_id),
g AS (SELECT rid, i, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 50, TRUE) AS fresh FROM p JOIN f USING (s) WHERE first_id < doc_id),
n AS (SELECT rid, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS span FROM g),
r AS MATERIALIZED (SELECT rid, span, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY rid, span),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY rid ORDER BY a) AS after FROM r),
t AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)) || CASE WHEN after IS NULL THEN substr(h, CAST(2 * b + 1 AS INTEGER)) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
