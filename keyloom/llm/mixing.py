"""Mixing to target weights by raking (DataFrame functions only).

Documents are counted in cells of (source, lang, topic) with their tokens as weight.
Iterative proportional fitting scales the cells to target shares of each marginal in turn, until
all are met within TOLERANCE (targets that exclude each other end after ROUNDS, with a warning). The factor
of a cell, over the largest factor, is the probability with which its documents
stay: the largest sample whose expected token shares meet the targets. A document
stays if a number drawn from a hash of its id is below that.

The counts by value are grouped sums over all documents; values with less than 1/RARE of all tokens are then one
group of their dimension, so the cells that the loop works on, and that are broadcast, are at most 257 x 257 x 4.

Tokens are the words of the text and one end mark, so no document weighs nothing. Targets not given are
the shares found, raised to TEMPER and made to sum to one; given targets are taken relative to
their sum over the values that occur.

Defined cases: null and empty values of a dimension are one value, ''; a null text has one token and
the topic 'prose'; a null id draws as the text "null"; repeated rows draw alike; an empty table gives an
empty result; further columns are carried along untouched.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, pack, table

DIMS = ("source", "lang", "topic")
GROUPS = tuple(f"g_{d}" for d in DIMS)
TEMPER = 0.7
#: A value with less than 1/RARE of all tokens is raked together with the other rare ones of its dimension, so that a
#: dimension has RARE + 1 groups at most, and no rare value sets the scale of all probabilities.
RARE = 256
#: The rounds end when every marginal, before its own step, is within this share of its goal; ROUNDS bounds them.
TOLERANCE = 1e-4
ROUNDS = 60
SYMBOLS = "#*$%&|<>"


def topic_of(text: Column) -> Column:
    """A topic by form: legal notices, contact data, markup, prose."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return (
        F.when(F.lower(t).contains("license"), "legal")
        .when(t.contains("@") | t.contains("://"), "contact")
        .when(symbols * 20 > F.length(t), "markup")
        .otherwise("prose")
    )


def token_weight(text: Column) -> Column:
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")) + 1).cast("long")


def draw(ident: Column) -> Column:
    """A uniform number in [0, 1) from an md5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def common(cells: DataFrame, wishes: Mapping[str, DataFrame]) -> DataFrame:
    """(dim, v): the values of each dimension that are raked by themselves, at most RARE of them and those with a target."""
    parts = []
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    for d in DIMS:
        found = cells.groupBy(F.col(d).alias("v")).agg(F.sum("tokens").alias("n"))
        often = F.col("n") * RARE >= F.lit(total)
        if d in wishes:
            found, often = found.join(wishes[d], F.col("v") == F.col("_v"), "left"), often | F.col("_v").isNotNull()
        parts.append(found.where(often).select(F.lit(d).alias("dim"), "v"))
    return reduce(DataFrame.union, parts)


def grouped(df: DataFrame, values: DataFrame) -> DataFrame:
    """df with the columns g_source, g_lang, g_topic: a common value after '=', all rare ones as '*'."""
    for d in DIMS:
        df = df.join(F.broadcast(values.where(F.col("dim") == d).select(F.col("v").alias(f"_{d}"))), F.col(d) == F.col(f"_{d}"), "left")
    return df.select(*[c for c in df.columns if c not in {f"_{d}" for d in DIMS}], *[F.when(F.col(f"_{d}").isNull(), "*").otherwise(F.concat(F.lit("="), F.col(d))).alias(f"g_{d}") for d in DIMS])


def rake_groups(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """The common values (dim, v), and (g_source, g_lang, g_topic, p) of the cells of groups.

    A round is three windows over the cells, which are few (see RARE). A cell carries how far its marginals were
    from their goals in the round (`off`), and the rounds end when that is within the tolerance everywhere.
    """
    wishes = {d: t.select(F.coalesce("value", F.lit("")).alias("_v"), F.col("share").cast("double").alias("s")) for d, t in (targets or {}).items()}
    values = cut(common(cells, wishes))
    few = cut(grouped(cells, values).groupBy(*GROUPS).agg(F.sum("tokens").cast("double").alias("tokens")))
    now = few.withColumn("w", F.col("tokens"))
    for d in DIMS:
        found = few.groupBy(F.col(f"g_{d}").alias("g")).agg(F.sum("tokens").alias("n"))
        if d in wishes:
            share = found.join(wishes[d], F.col("g") == F.concat(F.lit("="), F.col("_v")), "left").select("g", "n", F.coalesce("s", F.lit(0.0)).alias("s"))
        else:
            share = found.select("g", "n", F.pow(F.col("n"), F.lit(temper)).alias("s"))
        every = Window.partitionBy(F.lit(1))
        goal = share.select("g", (F.col("s") / F.sum("s").over(every) * F.sum("n").over(every)).alias(f"goal_{d}"))
        now = now.join(F.broadcast(goal), F.col(f"g_{d}") == F.col("g")).drop("g")
    gap = math.inf
    for _ in range(rounds):
        for d in DIMS:
            own = F.sum("w").over(Window.partitionBy(f"g_{d}"))
            now = now.withColumn("f", F.when(own > 0, F.col(f"goal_{d}") / own))
            off = F.abs(F.coalesce("f", F.lit(1.0)) - 1)
            now = now.withColumn("off", off if d == DIMS[0] else F.greatest("off", off)).withColumn("w", F.col("w") * F.coalesce("f", F.lit(0.0))).drop("f")
        now = cut(now)
        gap = now.agg(F.max("off").alias("x")).first()["x"] or 0.0
        if gap <= tolerance:
            break
    if gap > tolerance:
        warnings.warn(f"after {rounds} rounds a marginal was {gap:.2g} from its target", stacklevel=2)
    g = F.col("w") / F.col("tokens")
    most = now.agg(F.max(g).alias("g")).first()["g"] or 0.0
    return values, now.select(*GROUPS, (g / F.lit(most) if most > 0 else F.lit(0.0)).alias("p"))


def with_share(rows: DataFrame, raked: tuple[DataFrame, DataFrame]) -> DataFrame:
    """rows (with DIMS) and `p`. Common values and cells of groups are bounded by RARE, so they are broadcast."""
    values, cells = raked
    own = cells.select(*[F.col(g).alias(f"_{g}") for g in GROUPS], "p")
    met = grouped(rows, values).join(F.broadcast(own), [F.col(g) == F.col(f"_{g}") for g in GROUPS])
    return met.drop(*GROUPS, *[f"_{g}" for g in GROUPS])


def rake(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """From cells (DIMS, tokens) the same with `p`. A given target has columns (value, share)."""
    return with_share(cells.select(*DIMS, "tokens"), rake_groups(cells, targets, temper, rounds, tolerance))


def _dims(source: Column, lang: Column, text: Column) -> list[Column]:
    return [F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"), topic_of(text).alias("topic")]


def op3_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = cut(docs.select("doc_id", *_dims(F.col("source"), F.col("lang"), F.col("text")), token_weight(F.col("text")).alias("n_tokens")))
    met = with_share(rows, rake_groups(cut(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))))
    return met.select("doc_id", *DIMS, "n_tokens", F.round("p", 9).alias("p"), (draw(F.col("doc_id")) < F.col("p")).alias("sampled"))


def mix(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, source: str = "source", lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The sampled documents, columns as they came."""
    r = F.col("row")
    rows = pack(docs).select("row", *_dims(r[source], r[lang], r[text]))
    raked = rake_groups(cut(rows.groupBy(*DIMS).agg(F.sum(token_weight(r[text])).alias("tokens"))), targets)
    return with_share(rows, raked).where(draw(F.col("row")[doc_id]) < F.col("p")).select("row.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def _oracle() -> str:
    out = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
r AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN contains(lower(t), 'license') THEN 'legal'
    WHEN contains(t, '@') OR contains(t, '://') THEN 'contact'
    WHEN (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) * 20 > length(t) THEN 'markup' ELSE 'prose' END AS topic,
  len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + 1 AS n_tokens FROM t),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL)"""
    for d in DIMS:
        out += f""",
m_{d} AS MATERIALIZED (SELECT {d} FROM c GROUP BY {d} HAVING sum(tokens) * {RARE} >= (SELECT sum(tokens) FROM c))"""
    named = [f"CASE WHEN {d} IN (SELECT {d} FROM m_{d}) THEN '=' || {d} ELSE '*' END AS g_{d}" for d in DIMS]
    out += f""",
e AS MATERIALIZED (SELECT {', '.join(named)}, sum(tokens) AS tokens FROM c GROUP BY ALL)"""
    for d in DIMS:
        out += f""",
g_{d} AS MATERIALIZED (SELECT g_{d}, pow(n, {TEMPER}) / sum(pow(n, {TEMPER})) OVER () * sum(n) OVER () AS goal FROM (SELECT g_{d}, sum(tokens) AS n FROM e GROUP BY g_{d}))"""
    gs = ", ".join(GROUPS)
    step = "it"
    for d in DIMS:
        step = f"(SELECT k, {gs}, tokens, off, w, goal / nullif(sum(w) OVER (PARTITION BY g_{d}), 0) AS f FROM {step} JOIN g_{d} USING (g_{d}))"
        off = "abs(coalesce(f, 1) - 1)"
        step = f"(SELECT k, {gs}, tokens, {off if d == DIMS[0] else f'greatest(off, {off})'} AS off, w * coalesce(f, 0) AS w FROM {step})"
    out += f""",
it AS (SELECT 0 AS k, {gs}, tokens, CAST(1 AS DOUBLE) AS off, tokens AS w, CAST(1 AS DOUBLE) AS gap FROM e
  UNION ALL SELECT k + 1, {gs}, tokens, off, w, max(off) OVER () FROM {step.replace("FROM it ", "FROM (SELECT * FROM it WHERE k < " + str(ROUNDS) + f" AND gap > {TOLERANCE}) ")}),
last AS (SELECT * FROM it WHERE k = (SELECT max(k) FROM it))"""
    last = "last"
    return (
        out
        + f""",
p AS (SELECT {gs}, (w / tokens) / max(w / tokens) OVER () AS p FROM {last})
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(p, 9) AS p,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled
FROM (SELECT *, {', '.join(named)} FROM r) JOIN p USING ({gs})"""
    )


ORACLE = _oracle()
