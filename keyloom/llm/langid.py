"""Language identification by Bayesian fusion of evidence.

For each row the log posterior of a language is the sum of
- the text's log likelihood under a model of hashed byte trigrams, as the mean per trigram times at most
  MAX_EVIDENCE trigrams (neighbouring trigrams are not independent),
- the log of the host's prior, smoothed towards its domain's, which is smoothed towards the corpus's,
- log P(declared markup language | language) and log P(address suffix | language).
Priors and likelihoods are grouped counts over all rows, by the language that the text alone says.

The trigram model is fitted on a sample of labelled documents (`lang`), about SAMPLE_ROWS of them and LANG_ROWS
more of each rare language, drawn by a hash of id and text (null ids by the text); repeated rows are one row of the
sample; all else covers all rows. Languages are all labels, MAX_LANGS at most (128 KB each on the driver and each worker);
each has a row in the sample at least, if any of its texts has three bytes.

Defined cases: a null or short text says nothing, so priors decide; missing host, declaration and suffix are
values of their own; without labelled rows every language is "und"; ties go to the first language by
name; repeated rows count as often as they occur; empty tables give an empty result.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, lean_batches, table, unit_draw
from .pages import block, parse

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 4000
LANG_ROWS = 40
#: More languages are refused, before any is collected: their models would take over 256 MB of a worker.
MAX_LANGS = 2000
#: Languages whose dense counts a task holds at a time.
HELD_LANGS = 100
BUCKETS = 1 << 15
MAX_EVIDENCE = 60
#: Pseudo-counts of the level above in the host hierarchy, and of an evidence value.
PRIOR_ROWS, VALUE_ROWS = 20.0, 1.0
CHUNK = 1 << 20
LANG = re.compile(r"\s*([A-Za-z]{2,3}(?![A-Za-z]))?")


def buckets(raw: bytes) -> Iterator[np.ndarray]:
    """Trigram buckets of a text's lower-case bytes, in chunks."""
    a = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    for at in range(0, len(a) - 2, CHUNK):
        b = a[at : at + CHUNK + 2]
        yield ((b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA77 ^ b[2:] * 0xC2B2AE3D) >> 8) & (BUCKETS - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        at = [np.flatnonzero(v) for v in total.values()]
        columns = [pa.array(total, pa.string()), pa.array([i.tobytes() for i in at], pa.binary()), pa.array([v[i].tobytes() for v, i in zip(total.values(), at, strict=True)], pa.binary())]
        total.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "at", "counts"])

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in total and len(total) == HELD_LANGS:
                yield flush()
            own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for b in buckets(raw or b""):
                own += np.bincount(b, minlength=BUCKETS)
    yield flush()


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Log probabilities of trigram buckets by language."""
    known = docs.where("lang is not null and octet_length(text) >= 3").withColumn("_u", unit_draw(F.col("doc_id"), F.col("text")))
    langs = docs.where("lang is not null").select("lang").distinct()
    if langs.limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages: their models would not fit the workers")
    names = sorted(r["lang"] for r in langs.collect())
    found = known.groupBy("lang").agg(F.count("*").alias("_n"), F.min("_u").alias("_least")).collect()
    share = rows / max(1, sum(r["_n"] for r in found))
    upto = docs.sparkSession.createDataFrame([(r["lang"], max(share, LANG_ROWS / r["_n"], r["_least"])) for r in found], "_lang string, _upto double")
    sample = known.join(F.broadcast(upto), F.col("lang") == F.col("_lang")).where("_u <= _upto")
    # repeated rows draw alike: they are one row of the sample, and collapse before they move
    sample = sample.groupBy("lang", "_u").agg(F.first("text").alias("text")).select("lang", F.col("text").cast("binary"))
    total: dict[str, np.ndarray] = {x: np.zeros(BUCKETS, np.int64) for x in names}
    for r in sample.mapInArrow(_counts, "lang string, at binary, counts binary").collect():
        total[r["lang"]][np.frombuffer(r["at"], np.int64)] += np.frombuffer(r["counts"], np.int64)
    return {k: np.log((total[k] + 0.5) / (total[k].sum() + 0.5 * BUCKETS)).astype(np.float32) for k in sorted(total)}


def likelihoods(shared):
    @F.pandas_udf("array<double>")
    def of(raw: pd.Series) -> pd.Series:
        weights = shared.value

        def one(x: bytes | None) -> list[float]:
            total, n = np.zeros(len(weights)), 0
            for b in buckets(x or b""):
                total += [float(w[b].sum(dtype=np.float64)) for w in weights]
                n += len(b)
            return (total * (min(n, MAX_EVIDENCE) / n) if n else total).tolist()

        return raw.map(one)

    return of


def _tally(df: DataFrame, by: str, n: int) -> DataFrame:
    """(by, counts): rows of each value by the language that the text says."""
    sums = [F.sum((F.col("said") == i).cast("double")).alias(f"n{i}") for i in range(n)]
    return df.groupBy(by).agg(*sums, F.count("*").alias("rows")).select(by, "rows", F.array(*[f"n{i}" for i in range(n)]).alias("counts"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _smoothed(counts: Column, above: Column, weight: float) -> Column:
    return F.zip_with(counts, above, lambda c, p: (c + weight * p) / (_total(counts) + weight))


def fuse(rows: DataFrame, n: int) -> DataFrame:
    """rows (..., host, domain, declared, suffix, ll, said) with `logs`, the log posterior up to a constant."""
    found = _tally(rows.withColumn("_all", F.lit(1)), "_all", n).first()  # one row of n numbers
    counted = found["counts"] if found else [0.0] * n
    base = F.array(*[F.lit((c + PRIOR_ROWS / n) / (sum(counted) + PRIOR_ROWS)) for c in counted])
    totals = F.array(*[F.lit(c) for c in counted])
    many = found["rows"] if found else 0
    domains = _tally(rows, "domain", n).select(F.col("domain").alias("_d"), _smoothed(F.col("counts"), base, PRIOR_ROWS).alias("domain_p"))
    hosts = rows.select("host", "domain", "said").withColumn("_host", F.struct("domain", "host"))
    hosts = _tally(hosts, "_host", n).select("_host.*", "rows", "counts")
    hosts = hosts.join(domains, F.col("domain") == F.col("_d")).select(F.col("domain").alias("_hd"), F.col("host").alias("_h"), "rows", _smoothed(F.col("counts"), F.col("domain_p"), PRIOR_ROWS).alias("host_p"))

    def given(by: str) -> DataFrame:
        own = cut(_tally(rows, by, n))
        values = float(own.count())
        return own.select(F.col(by).alias(f"_{by}"), "rows", F.zip_with("counts", totals, lambda c, t: (c + VALUE_ROWS) / (t + VALUE_ROWS * values)).alias(f"{by}_p"))

    out = rows.withColumn("_number", F.monotonically_increasing_id())  # here rows come from a scan; after a join their order can differ in a second try
    out = hot_join(out, cut(hosts), [("domain", "_hd"), ("host", "_h")], "rows", many, number="_number")
    for by in ("declared", "suffix"):
        out = hot_join(out, given(by), [(by, f"_{by}")], "rows", many, number="_number")
    logs = F.transform("ll", lambda x, i: x + F.log(F.get("host_p", i)) + F.log(F.get("declared_p", i)) + F.log(F.get("suffix_p", i)))
    return out.drop("_number").withColumn("logs", logs)


def identify(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """rows (doc_id, page_id, host, domain, declared, suffix, text) with lang, posterior and text_lang; without the text."""
    spark = rows.sparkSession
    lean_batches(spark)
    model = fit(labelled) or {"und": np.zeros(BUCKETS, np.float32)}
    names = F.array(*[F.lit(x) for x in model])
    shared = spark.sparkContext.broadcast(list(model.values()))
    first = lambda x: F.array_position(x, F.array_max(x)) - 1
    kept = ["doc_id", "page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "domain", "declared", "suffix")]]
    scored = cut(rows.select(*kept, likelihoods(shared)(F.col("text").cast("binary")).alias("ll")).withColumn("said", first(F.col("ll"))))
    fused = fuse(scored, len(model)).withColumn("best", F.array_max("logs"))
    posterior = 1 / _total(F.transform("logs", lambda x: F.exp(x - F.col("best"))))
    return fused.select("doc_id", "page_id", F.get(names, first(F.col("logs")).cast("int")).alias("lang"), F.round(posterior, 6).alias("posterior"), F.get(names, F.col("said").cast("int")).alias("text_lang"), "declared", "suffix", "host")


def evidence():
    """A UDF from pages to the language that a page declares (two or three letters that begin its lang), and its visible text."""

    def one(raw: str | None) -> tuple[str, str]:
        if not raw:
            return "", ""
        root = parse(raw)
        return (LANG.match(root.attrs.get("lang", ""))[1] or "").lower(), "\n".join(block(root))

    @F.pandas_udf("declared string, text string")
    def of(page: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in page], columns=["declared", "text"])

    return of


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the host and its last two labels, the declared language, and the address suffix
    (a language code that leads the path, else the top-level domain)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    code = F.lower(F.regexp_extract("url", r"^[^/]*//[^/]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    top = F.regexp_extract(host, r"([^.]+)$", 1)
    seen = evidence()(F.col("html"))
    return pages.select("page_id", host.alias("host"), F.when(code != "", F.concat(F.lit("/"), code)).otherwise(top).alias("suffix"), seen.alias("seen")).select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), F.col("seen.declared").alias("declared"), "suffix", F.col("seen.text").alias("text")
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents have a source as their host, and no markup or address."""
    none = F.lit("")
    return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.col("source").alias("host"), F.lit("documents").alias("domain"), none.alias("declared"), none.alias("suffix"), "text")


def op5_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = document_rows(docs).unionByName(page_rows(table(spark, sf_dir, "pages")))
    return identify(rows, docs)
