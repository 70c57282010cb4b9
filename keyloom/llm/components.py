"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one grouped minimum with a join, in which the rows of a node with many links are
spread; links are never gathered in a task or on the driver. Each round is cut into the shared folder, and the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, release

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the rows (node, root) of all linked nodes; root is the least node reached.

    Null ends and links of a node to itself are ignored; repeated links count once.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = cut(links), None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or mark["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct()) if mark["n"] else now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select(F.col("x").alias("c"), F.least("x", "m").alias("m"), "n")
        large = hot_join(both.where("y > x"), least, [("x", "c")], "n", 2 * mark["n"])
        large = cut(large.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "c")
        star = hot_join(large, low, [("u", "c")], "n", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(star.union(low.select("c", "m")).distinct())
        release(now)
        release(large)
        now = nxt
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
