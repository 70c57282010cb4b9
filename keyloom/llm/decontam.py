"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark texts are normalised to lower-case words. A window is a run of 13 words of an item (or
a whole shorter item). Any window holds one of the item's blocks of seven words at the places 0, 7, 14, ..., so the
automaton has these blocks only: about one node for each character of the benchmark. Every document is normalised byte by byte, so that
each normalised byte sits where its original does; the automaton reads its joined words once. Around each block that it finds, document and
item are compared as far as they agree, and an agreement of 13 words or more is hit. Word offsets map back to the original.

A worker holds one automaton, of items of at most MAX_CHARS characters together, and builds it once. A larger
benchmark is dealt into as many blocks of items as that takes. The first is scanned where the documents are read; each
other one is a scan of its own, and what it finds is joined to the documents, which are written once for that. One item is
never cut.

Defined cases: null or wordless texts have no words and no hits; an item without
words is ignored; a null item_id marks hits but is not listed; repeated items count once; an empty
benchmark leaves every document clean; further columns are carried along untouched.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean_batches, pack, table, unpack

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN = 13
#: Hit words are at least a twentieth of the words of a contaminated document.
HIT_SHARE = 20
#: Characters of the items of one automaton: a node of about 51 bytes each, so 200 MB.
MAX_CHARS = 4_000_000

#: Bytes that are no part of words become spaces, A-Z become lower case.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


class Automaton:
    """The words of benchmark items, and one automaton over their blocks."""

    def __init__(self, items: list[tuple[object, str | None]], span: int = SPAN):
        self.span = span
        self.ids: list[object] = []
        self.texts: list[list[bytes]] = []
        width = (span + 1) // 2
        blocks: dict[bytes, tuple[int, list]] = {}
        for ident, text in items:
            own = words_of((text or "").encode("utf-8", "replace"))
            if not own:
                continue
            length = len(own) if len(own) < span else width
            for o in range(0, len(own) - length + 1, length):
                blocks.setdefault(b" ".join(own[o : o + length]), (length, []))[1].append((len(self.ids), o))
            self.ids.append(ident)
            self.texts.append(own)
        self.auto = ahocorasick.Automaton()
        for block, found in blocks.items():
            self.auto.add_word(f" {block.decode('utf-8', 'replace')} ", found)
        if blocks:
            self.auto.make_automaton()

    def scan(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit intervals of word positions, items found."""
        doc = words_of(raw)
        text = f" {b' '.join(doc).decode('utf-8', 'replace')} "
        hits = list(self.auto.iter(text)) if doc and self.ids else []
        if not hits:
            return len(doc), [], set()
        gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) == 32)
        ends = np.searchsorted(gaps, [end for end, _ in hits]).tolist()  # word after the block
        spans, items, done = [], set(), {}
        for end, (_, (length, places)) in zip(ends, hits, strict=True):
            first = end - length
            for at, o in places:
                own = self.texts[at]
                a, x, b, y = first, o, end, o + length
                if len(own) >= self.span:  # how far document and item agree around the block
                    if done.get((at, first - o), -1) >= end:
                        continue
                    while a and x and doc[a - 1] == own[x - 1]:
                        a, x = a - 1, x - 1
                    while b < len(doc) and y < len(own) and doc[b] == own[y]:
                        b, y = b + 1, y + 1
                    done[at, first - o] = b
                    if b - a < self.span:
                        continue
                spans.append((a, b))
                if self.ids[at] is not None:
                    items.add(self.ids[at])
        return len(doc), united(spans), items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of intervals of word positions."""
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    chars = lambda b: len(raw[:b].decode("utf-8", "replace"))
    return [(chars(at[a][0]), chars(at[b - 1][1])) for a, b in spans]


def scanner(shared):
    """A UDF over the texts of a task. The automaton of the broadcast items is built once in a worker, and kept with them."""

    @F.pandas_udf("n_words long, hits array<struct<a:long,b:long>>, items array<string>")
    def block(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shared.value
        if "automaton" not in held:
            held["automaton"] = Automaton(held["items"])
        for texts in parts:
            rows = []
            for raw in texts:
                n, spans, ids = held["automaton"].scan(raw)
                rows.append((n, [{"a": a, "b": b} for a, b in spans], sorted(map(str, ids))))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return block


def item_blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """Distinct items in blocks of about `limit` characters; a block is all that the driver and a broadcast hold."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    size = rows.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // limit))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for b in range(n):
        yield [tuple(r) for r in rows.where(F.col("b") == b).select("i", "t").collect()]


def united_column(hits: Column) -> Column:
    """Overlapping and touching intervals made one."""
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))))
    return F.aggregate(F.array_sort(hits), none, lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["b"] >= s["a"]), longer(acc, s)).otherwise(F.concat(acc, F.array(s))))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """`row` (all columns of docs), n_words, hits (intervals of word positions), n_hit, item_ids (sorted strings)."""
    spark = docs.sparkSession
    lean_batches(spark)
    body = F.col("row")[text].cast("binary")
    scan_of = lambda items: scanner(spark.sparkContext.broadcast({"items": items}))(body).alias("f")
    first, *others = [scan_of(items) for items in item_blocks(benchmark, item, item_text, max_chars)]
    if not others:
        out = pack(docs).select("row", first).select("row", "f.n_words", "f.hits", F.array_sort("f.items").alias("item_ids"))
    else:
        rows = cut(pack(docs).withColumn("rid", F.monotonically_increasing_id()))
        found = reduce(DataFrame.union, [rows.select("rid", f).select("rid", "f.hits", "f.items").where(F.size("hits") > 0) for f in others])
        more = cut(found.groupBy("rid").agg(F.flatten(F.collect_list("hits")).alias("h"), F.flatten(F.collect_list("items")).alias("i")).withColumnRenamed("rid", "r"))
        met = rows.select("row", "rid", first).join(more, F.col("rid") == F.col("r"), "left")
        hits = F.when(F.col("h").isNull(), F.col("f.hits")).otherwise(united_column(F.concat("f.hits", "h")))
        ids = F.when(F.col("i").isNull(), F.col("f.items")).otherwise(F.concat("f.items", "i"))
        out = met.select("row", "f.n_words", hits.alias("hits"), F.array_sort(F.array_distinct(ids)).alias("item_ids"))
    return out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))


def locate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The contaminated passages: `row` of docs and `spans`, character offsets in the original text."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def to_original(raw: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in original_spans(r or b"", [(h["a"], h["b"]) for h in hs])] for r, hs in zip(raw, hits, strict=True)])

    found = find_hits(docs, benchmark, text).where("n_hit > 0")
    return found.select("row", "item_ids", to_original(F.col("row")[text].cast("binary"), "hits").alias("spans"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; columns as they came."""
    return unpack(find_hits(docs, table(spark, sf_dir, "benchmark")).where(~contaminated()))


ORACLE = r"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 13) AS n, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS win FROM it WHERE len(ws) > 0),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
pos AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM iw) ON len(ws) >= n),
hit AS MATERIALIZED (SELECT rid, i, a.n, item_id FROM (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM pos) AS a JOIN iw ON a.n = iw.n AND a.win = iw.win),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN ids USING (rid)
"""
