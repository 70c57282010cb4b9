"""Figures of a filter and of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.hashing import HashFamily
from keyloom.operators.discover import candidates, discover_mcr, plain, verify
from keyloom.operators.query import QuerySpec


def filter_precision(index: DataFrame, query: QuerySpec, fam: HashFamily | None, postings: DataFrame | None = None) -> DataFrame:
    """One row: candidates approved, of those matched, false positives, precision (null without candidates)."""
    cand = candidates(index, query, fam)
    pairs = verify(cand, plain(index) if postings is None else postings, query)
    n = F.coalesce(F.sum("m"), F.lit(0))
    both = cand.agg(n.alias("approved")).withColumn("matched", pairs.agg(n.alias("matched")).scalar())
    return both.select("approved", "matched", (F.col("approved") - F.col("matched")).alias("false_positives"), F.try_divide("matched", "approved").alias("precision"))


def approved_rows(index: DataFrame, query: QuerySpec, fam: HashFamily | None) -> DataFrame:
    """(table_id, n_rows): distinct lake rows that pass the filter."""
    return candidates(index, query, fam).groupBy("table_id").agg(F.count_distinct("row_id").alias("n_rows"))


def mean_joinability(postings: DataFrame, query: QuerySpec, k: int = 10) -> DataFrame:
    """The mean score of the best k of the intersection baseline, 0 without any."""
    return discover_mcr(postings, query, k).agg(F.coalesce(F.avg("n_pairs"), F.lit(0.0)).alias("mean_pairs"))
