"""Quality rules with host verdicts (DataFrame functions only).

Each document gets base statistics and fails the base rule when it is short or
repeats itself. Failures are then aggregated by host; a host's failure rate is shrunk
towards the rates of all hosts with a beta prior fitted by the method of
moments; documents of hosts whose shrunk rate is high are rejected as well.

Defined cases: a null or blank text has no words and fails as short; a null host
is a host of its own; an empty table gives an empty result; repeated rows
count as often as they occur; further columns are carried along untouched.
Windows are compared by 64-bit hashes of their words, so a text of n words
is misjudged with a probability below n**2 / 2**64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, cut, hot_join, pack, table, unpack

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A host is rejected above this shrunk failure rate.
MAX_HOST_RATE = 0.8
#: Bounds of the fitted prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_base(df: DataFrame, text: F.Column) -> DataFrame:
    """Add the base statistics of `text` as the columns BASE.

    Arrays that a lambda reads again are columns of their own, read twice or more,
    so that the optimizer does not move their computation into the lambda.
    """
    has_word = r"[^\x20\x09-\x0D]"
    w = WINDOW
    df = df.withColumn("_t", F.coalesce(text, F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("_t", WORD_GAP), ""))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(has_word)))
    df = df.select(
        *[c for c in df.columns if c not in ("_t", "_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", WORD_GAP, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hash"),
    )
    starts = F.slice("_hash", F.lit(1), F.greatest(F.size("_hash") - (w - 1), F.lit(0)))
    df = df.withColumn("_win", F.transform(starts, lambda _, i: F.xxhash64(F.slice("_hash", i + 1, w))))
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.drop("_hash", "_win")
    at = lambda j: F.get(F.col("_sorted"), j)["h"]
    twice = F.filter("_sorted", lambda e, j: F.coalesce(e["h"] == at(j - 1), F.lit(False)) | F.coalesce(e["h"] == at(j + 1), F.lit(False)))
    start = F.sort_array(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(
        start,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + w).alias("end"), (a["n"] + i + w - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("_sorted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_verdicts(rated: DataFrame) -> DataFrame:
    """One row per host of (host, base_failed): documents, failures, shrunk rate, verdict.

    The prior's mean m is the failure rate of all documents. The variance v of the hosts' rates, weighted by
    documents and less what chance alone makes of it, gives the prior's weight m(1-m)/v - 1, held
    within PRIOR_WEIGHT.
    """
    hosts = rated.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    sums = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("q"), F.count("*").alias("h"))
    m = F.col("f") / F.col("n")
    spread = F.col("q") / F.col("n") - m * m - m * (1 - m) * F.col("h") / F.col("n")
    weight = F.greatest(F.lit(PRIOR_WEIGHT[0]), F.least(F.lit(PRIOR_WEIGHT[1]), m * (1 - m) / F.greatest(spread, F.lit(1e-6)) - 1))
    prior = sums.select(m.alias("m"), weight.alias("k"))
    m = prior.select("m").scalar()
    k = prior.select("k").scalar()
    shrunk = (F.col("failed") + k * m) / (F.col("n") + k)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_failed", F.col("host_rate") > MAX_HOST_RATE)


def judge(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """`row` (all columns of docs), the base statistics, host_rate and `kept`.

    The rated rows are written once: the statistics are the dear part, and both the
    host aggregate and the verdict read them. So are the verdicts: those of hot hosts are broadcast, and so are the others where their
    file is below Spark's broadcast threshold.
    """
    rated = cut(with_base(pack(docs).withColumn("host", F.col("row")[host]), F.col("row")[text]))
    joined = with_verdicts(rated)
    return joined.select("row", *BASE, "host_rate", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


def with_verdicts(rated: DataFrame) -> DataFrame:
    """rated (a written table with host, base_failed) with host_rate and host_failed."""
    hosts = cut(host_verdicts(rated.select("host", "base_failed")).select(F.col("host").alias("_host"), "n", "host_rate", "host_failed"))
    total = hosts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return hot_join(rated, hosts, [("host", "_host")], "n", total)


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # the result needs no text, so only the statistics are written
    rated = cut(with_base(docs.select("doc_id", F.col("source").alias("host"), "text"), F.col("text")).drop("text"))
    joined = with_verdicts(rated)
    kept = ~F.col("base_failed") & ~F.col("host_failed")
    return joined.select("doc_id", *BASE, kept.alias("kept"), F.round("host_rate", 9).alias("host_rate"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; columns as they came."""
    return unpack(judge(docs).where("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT rid, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
win AS (SELECT rid, i, array_to_string(ws[i + 1:i + 8], ' ') AS win
        FROM (SELECT rid, ws, unnest(range(0, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, nxt - i)) AS n FROM (
        SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 8) AS nxt FROM rep) GROUP BY rid),
r AS (SELECT b.*, coalesce(cov.n, 0) AS n_repeat_words FROM b LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS failed FROM f GROUP BY source),
p AS (SELECT f / n AS m, q / n - (f / n) * (f / n) - (f / n) * (1 - f / n) * h / n AS v FROM (
      SELECT sum(n) AS n, sum(failed) AS f, sum(failed * failed / n) AS q, count(*) AS h FROM h)),
k AS (SELECT m, greatest(2.0, least(1000.0, m * (1 - m) / greatest(v, 1e-6) - 1)) AS k FROM p),
hv AS (SELECT source, (failed + k * m) / (n + k) AS host_rate FROM h, k)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(hv.host_rate > 0.8, FALSE) AS kept, round(host_rate, 9) AS host_rate
FROM f LEFT JOIN hv ON f.source IS NOT DISTINCT FROM hv.source
"""
