"""Query tables: deduplicated, cleaned, complete keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.text import MISSING, clean_text


@dataclass(frozen=True)
class QuerySpec:
    """Distinct key tuples (k0, k1, ..., m) of a query table, m the rows that have it; order[i] is the user's position of k{i}."""

    rows: DataFrame
    order: tuple[int, ...]

    @property
    def n(self) -> int:
        return len(self.order)

    @property
    def keys(self) -> list[str]:
        return [f"k{i}" for i in range(self.n)]

    @classmethod
    def from_df(cls, df: DataFrame, keys: Sequence[str], clean: bool = True) -> QuerySpec:
        """Repeated raw keys are dropped first, then keys are cleaned and rows that miss one go.

        Rows that become equal by cleaning stay, and count each.
        """
        if not keys:
            raise ValueError("a query needs a key column")
        raw = df.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]).dropDuplicates()
        names = [f"k{i}" for i in range(len(keys))]
        whole = not clean and all(isinstance(f.dataType, T.IntegralType) for f in df.select(*[F.col(k) for k in keys]).schema)
        if whole:  # whole numbers have no case: what is distinct stays so
            return cls(raw.where(reduce(and_, [F.col(c).isNotNull() for c in names])).withColumn("m", F.lit(1).cast("long")), tuple(range(len(keys))))
        rows = raw.select(*[(clean_text(F.col(c)) if clean else F.lower(F.col(c))).alias(c) for c in names])
        for c in names:
            rows = rows.where(F.col(c).isNotNull() & ~F.col(c).isin(*MISSING))
        return cls(rows.groupBy(*names).agg(F.count("*").alias("m")), tuple(range(len(keys))))

    def size(self) -> int:
        return self.rows.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()["n"]

    def reordered(self, first: int) -> QuerySpec:
        """The key at position `first` leads."""
        at = [first, *[i for i in range(self.n) if i != first]]
        rows = self.rows.select(*[F.col(f"k{j}").alias(f"k{i}") for i, j in enumerate(at)], "m")
        return QuerySpec(rows, tuple(self.order[j] for j in at))


def key_counts(query: QuerySpec) -> DataFrame:
    """(position, n_distinct) of each key column, from one job."""
    wide = query.rows.agg(*[F.count_distinct(k).alias(k) for k in query.keys])
    return wide.unpivot([], query.keys, "k", "n_distinct").select(F.substring("k", 2, 9).cast("int").alias("position"), "n_distinct")


def initial_column(query: QuerySpec) -> QuerySpec:
    """The key with the fewest distinct values leads; the earliest wins a tie."""
    best = key_counts(query).orderBy("n_distinct", "position").first()
    return query.reordered(best["position"]) if best else query


def cheapest_column(query: QuerySpec, postings: DataFrame) -> QuerySpec:
    """The key with the shortest posting lists leads: the candidates to be verified are fewest."""
    per_token = postings.groupBy("token").agg(F.count("*").alias("n"))
    long = query.rows.unpivot(["m"], query.keys, "k", "token")
    best = long.groupBy("k", "token").agg(F.sum("m").alias("m")).join(per_token, "token").groupBy("k").agg(F.sum(F.col("m") * F.col("n")).alias("cost")).orderBy("cost", "k").first()
    return query.reordered(int(best["k"][1:])) if best else query
