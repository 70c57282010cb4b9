"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards with weights; a node's
weight is the sum below it. A document descends region, rack and shard; at each level
every child draws -ln(u) / weight from a hash of the document's id and the child's name,
and the least draw wins. A child's draw depends on its own name and weight only,
so a change of weights moves documents into or out of the changed subtrees and
nowhere else.

Law of the query: `key`. The document id and the tree decide the shard. One more shard
opens a region of its own, whose subtree holds nothing else, so documents move
only into the new shard.

Slots number the documents of a shard without gaps. They are dealt in blocks: blocks by
a hash of the id, an exclusive sum of block counts (a bounded table: shards x blocks), and a
row number inside each block, so that no task holds a shard.

Defined cases: null ids hash as the string "null" and so share a shard; a null text has
size 1 and checksum 0; equal ids share a shard and get different slots, equal rows in either
order; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pack, table, unit_draw

N_SHARDS = 8
#: Rows of one block in which slots are numbered, about.
BLOCK_ROWS = 50_000
MAX_BLOCKS = 1 << 16

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def base_tree(n_shards: int = N_SHARDS, racks: int = 2, per_rack: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Shards 0 to n-1 of weight 1, filled rack by rack and region by region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(n_shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack % racks}", {})[s] = 1.0
    return tree


def grow(tree: Tree, shard: int, weight: float = 1.0) -> dict:
    """The tree with one more shard in a region of its own."""
    return {**tree, f"added{shard}": {"rack0": {shard: weight}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key, as nested built-in expressions: level by level, the child with the least draw."""

    def descend(path: str, node) -> Column:
        if not isinstance(node, Mapping):
            return F.lit(int(path.rsplit("/", 1)[1]))
        names = [k for k in node if _weight(node[k]) > 0]
        if len(names) == 1:
            return descend(f"{path}/{names[0]}", node[names[0]])
        draws = [F.struct((-F.log(unit_draw(key, F.lit(f"{path}/{k}"))) / F.lit(_weight(node[k]))).alias("d"), F.lit(i).alias("i")) for i, k in enumerate(names)]
        won = F.least(*draws)["i"]
        out = descend(f"{path}/{names[-1]}", node[names[-1]])
        for i, k in reversed(list(enumerate(names[:-1]))):
            out = F.when(won == i, descend(f"{path}/{k}", node[k])).otherwise(out)
        return out

    if _weight(tree) <= 0:
        raise ValueError("the tree has no weight")
    return descend("", tree).cast("int")


def number_slots(df: DataFrame, shard: str, order: list[str], blocks: int | None = None) -> DataFrame:
    """Add `slot`: 0, 1, ... in each shard, without gaps."""
    if blocks is None:
        blocks = max(1, min(MAX_BLOCKS, df.count() // BLOCK_ROWS + 1))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = df.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_block")) - F.col("_n")
    base = counts.select(F.col(shard).alias("_s"), F.col("_block").alias("_b"), before.alias("_base"))
    inner = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order)) - 1
    joined = df.withColumn("_rank", inner).join(base, (F.col(shard) == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_base") + F.col("_rank")).cast("long")).drop("_s", "_b", "_block", "_rank", "_base")


def assign(docs: DataFrame, tree: Tree | None = None, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of every row; no text is shuffled."""
    tree = tree or base_tree()
    grown = grown or grow(tree, N_SHARDS)
    body = F.coalesce(F.col("row")[text], F.lit("")).cast("binary")
    ident = F.coalesce(F.col("row")[key].cast("string"), F.lit("null"))
    rows = pack(docs).select(
        F.col("row")[key].alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        ident.alias("_id"),
    )
    rows = cut(rows.select(key, "size", "text_crc32", F.lit("key").alias("law"), place(F.col("_id"), tree).alias("shard"), place(F.col("_id"), grown).alias("grown_shard")))
    return number_slots(rows, "shard", [key, "text_crc32", "size"])


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each document goes."""
    return assign(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
