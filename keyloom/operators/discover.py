"""Discovery of the tables that can be joined with a query on all of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.hashing import HashFamily, contains
from keyloom.functions.text import normalise_stored
from keyloom.operators.query import QuerySpec, initial_column


def posting_lists(postings: DataFrame, values: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct postings of a column's values; with a limit, of the normalised stored token, least first."""
    want = values.select(F.col(column).alias("_v")).distinct()
    if limit is None:
        return postings.join(want, F.col("token") == F.col("_v"), "left_semi").distinct()
    met = postings.join(want, normalise_stored(F.col("token")) == F.col("_v"), "left_semi").distinct()
    return met.orderBy("table_id", "row_id", "col_id", "token").limit(limit)


def fetch_rows(postings: DataFrame, rows: DataFrame) -> DataFrame:
    """All postings of the given (table_id, row_id)."""
    return postings.join(rows.select("table_id", "row_id").distinct(), ["table_id", "row_id"], "left_semi")


def table_hits(postings: DataFrame, query: QuerySpec) -> DataFrame:
    """(table_id, n_hits): postings of the first key."""
    return posting_lists(postings, query.rows, "k0").groupBy("table_id").agg(F.count("*").alias("n_hits"))


def min_join_filter(hits: DataFrame, at_least: float, absolute: bool, input_size: int | Column) -> DataFrame:
    """Tables with enough postings: a count, or a share of the query's rows (rounded half to even)."""
    least = F.lit(at_least) if absolute else F.bround(F.lit(at_least) * (F.lit(input_size) if isinstance(input_size, int) else input_size))
    return hits.where(F.col("n_hits") >= least)


def candidates(index: DataFrame, query: QuerySpec, fam: HashFamily | None = None) -> DataFrame:
    """(keys, m, table_id, row_id, c0): lake rows that hold the first key and, with a family, whose super key
    holds the query row's. The bit test is a residual of the equi-join; Spark broadcasts the query if it is small."""
    q = query.rows
    on = F.col("token") == F.col("k0")
    if fam is not None:
        for k in query.keys:  # each distinct value is hashed once
            q = q.join(fam.attach(query.rows.select(k).distinct(), k, f"{k}_"), k)
        q = q.select(*query.keys, "m", *[_or([F.col(f"{k}_{c}") for k in query.keys]).alias(f"q_{c}") for c in fam.columns])
        on = on & contains([F.col(c) for c in fam.columns], [F.col(f"q_{c}") for c in fam.columns])
    return index.join(q, on).select(*query.keys, "m", "table_id", "row_id", F.col("col_id").alias("c0"))


def plain(index: DataFrame) -> DataFrame:
    return index.select("table_id", "row_id", "col_id", "token")


def _or(parts) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out.bitwiseOR(x)
    return out


def verify(cand: DataFrame, postings: DataFrame, query: QuerySpec, mode: str = "concat") -> DataFrame:
    """(keys, m, table_id, row_id, c0, mapping) of candidates whose other keys all occur in the row.

    mode concat: one mapping per (query row, lake row, c0), with all columns of each further key, ascending.
    mode injective: one mapping per choice of distinct columns, in the user's key order.
    """
    ident = [*query.keys, "m", "table_id", "row_id", "c0"]
    if query.n == 1:
        return cand.withColumn("mapping", F.col("c0").cast("string"))
    rest = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"k{i}").alias("token")) for i in range(1, query.n)]))
    need = cand.select(*ident, rest.alias("r")).select(*ident, "r.pos", "r.token")
    cells = need.join(postings.select("table_id", "row_id", "col_id", "token"), ["table_id", "row_id", "token"])
    grouped = cells.groupBy(*ident).agg(F.array_sort(F.collect_set(F.struct("pos", "col_id"))).alias("cells"), F.count_distinct("pos").alias("n"))
    whole = grouped.where(F.col("n") == query.n - 1)
    if mode == "concat":
        mapping = F.concat_ws("_", F.col("c0").cast("string"), F.transform("cells", lambda c: c["col_id"].cast("string")))
        return whole.select(*ident, mapping.alias("mapping"))
    if mode != "injective":
        raise ValueError("mode is concat or injective")
    paths = whole.withColumn("path", F.array("c0"))
    for i in range(1, query.n):
        paths = paths.withColumn("cell", F.explode("cells")).where(F.col("cell.pos") == i).where(~F.array_contains("path", F.col("cell.col_id")))
        paths = paths.withColumn("path", F.array_append("path", F.col("cell.col_id"))).drop("cell")
    users = [F.element_at("path", query.order.index(i) + 1).cast("string") for i in range(query.n)]
    return paths.select(*ident, F.concat_ws("_", *users).alias("mapping"))


def score(pairs: DataFrame, query: QuerySpec) -> DataFrame:
    """(table_id, mapping, n_pairs, j_distinct)."""
    return pairs.groupBy("table_id", "mapping").agg(F.sum("m").alias("n_pairs"), F.count_distinct(*query.keys).alias("j_distinct"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The best mapping of each table, and of those the best k."""
    own = Window.partitionBy("table_id").orderBy(F.desc("n_pairs"), "mapping")
    best = scores.withColumn("r", F.row_number().over(own)).where("r = 1").drop("r")
    top = best.orderBy(F.desc("n_pairs"), "table_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_pairs"), "table_id")).cast("long")).select("rank", "table_id", "mapping", "n_pairs", "j_distinct")


def discover(
    index: DataFrame,
    query: QuerySpec,
    k: int = 10,
    fam: HashFamily | None = None,
    mode: str = "concat",
    run_ics: bool = False,
    min_join: float | None = None,
    absolute: bool = False,
    prune: int | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """The k best tables. index: postings, with super keys if a family is given (None: no prefilter).

    postings: the same without keys, for verification; to be given where the index is not a stored table, so that the
    keys are not made twice.

    prune: score that many tables of the largest bounds first, and drop the tables whose bound (candidate
    pairs before any filter) is below the k-th score; the result is the same.
    """
    if run_ics:
        query = initial_column(query)
    postings = plain(index) if postings is None else postings
    if min_join is not None:
        n = None if absolute else query.size()
        keep = min_join_filter(table_hits(postings, query), min_join, absolute, n or 0)
        index = index.join(keep.select("table_id"), "table_id", "left_semi")
        postings = postings.join(keep.select("table_id"), "table_id", "left_semi")
    if prune is not None:
        bound = candidates(index, query).groupBy("table_id").agg(F.sum("m").alias("bound"))
        first = bound.orderBy(F.desc("bound"), "table_id").limit(max(prune, k))
        some = index.join(first.select("table_id"), "table_id", "left_semi")
        best = top_k(score(verify(candidates(some, query, fam), postings, query, mode), query), k).collect()
        least = best[-1]["n_pairs"] if len(best) == k else 0
        keep = bound.where(F.col("bound") >= least).select("table_id")
        index = index.join(keep, "table_id", "left_semi")
    return top_k(score(verify(candidates(index, query, fam), postings, query, mode), query), k)


def discover_mcr(postings: DataFrame, query: QuerySpec, k: int = 10, max_tables: int | None = 500) -> DataFrame:
    """The baseline that intersects one posting list per key: the k best (table, columns), not tables."""
    hits = posting_lists(postings, query.rows, "k0")
    if max_tables is not None:
        top = hits.groupBy("table_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "table_id").limit(max_tables)
        hits = hits.join(top.select("table_id"), "table_id", "left_semi")
    met = hits.select("table_id", "row_id", F.col("col_id").alias("c0"), F.col("token").alias("t0"))
    for i in range(1, query.n):
        own = posting_lists(postings, query.rows, f"k{i}").select("table_id", "row_id", F.col("col_id").alias(f"c{i}"), F.col("token").alias(f"t{i}"))
        met = met.join(own, ["table_id", "row_id"])
        for j in range(i):
            met = met.where(F.col(f"c{i}") != F.col(f"c{j}"))
    on = [F.col(f"t{i}") == F.col(f"k{i}") for i in range(query.n)]
    cols = [f"c{i}" for i in range(query.n)]
    counted = met.join(query.rows, on).groupBy("table_id", *cols).agg(F.sum("m").alias("n_pairs"))
    return counted.orderBy(F.desc("n_pairs"), "table_id", *cols).limit(k)


def augment(query_df: DataFrame, lake_df: DataFrame, on: dict[str, str]) -> DataFrame:
    """The query's rows with the columns of a table found; on: query column to lake column."""
    lake = lake_df.select(*[F.col(c).alias(f"lake_{c}") for c in lake_df.columns])
    return query_df.join(lake, [F.col(a) == F.col(f"lake_{b}") for a, b in on.items()], "left")
