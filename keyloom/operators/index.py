"""Super keys of rows, and the index: postings with the key of their row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.hashing import HashFamily, family


def row_keys(postings: DataFrame, fam: HashFamily) -> DataFrame:
    """(table_id, row_id, sk0, ...): the OR of the lanes of a row's tokens.

    Each distinct token is hashed once and joined back: tokens repeat, and a hash costs more
    than moving a posting.
    """
    words = fam.attach(postings.select("token").distinct(), "token")
    return postings.select("table_id", "row_id", "token").join(words, "token").groupBy("table_id", "row_id").agg(*[F.bit_or(c).alias(c) for c in fam.columns])


def build_index(postings: DataFrame, fam: HashFamily) -> DataFrame:
    """Postings with the super key of their row."""
    return postings.join(row_keys(postings, fam), ["table_id", "row_id"])


def write_index(index: DataFrame, fam: HashFamily, path: str, partitions: int | None = None) -> None:
    """Clustered by token, so that a query's tokens skip row groups; the family goes with it."""
    spark = index.sparkSession
    spread = index.repartitionByRange(partitions, "token") if partitions else index.repartitionByRange("token")
    spread.sortWithinPartitions("token", "table_id", "row_id").write.mode("overwrite").parquet(f"{path}/postings")
    write_family(spark, fam, f"{path}/family")


def write_family(spark: SparkSession, fam: HashFamily, path: str) -> None:
    meta = json.dumps({"name": fam.name, "bits": fam.bits, "ones": fam.ones, "flags": dict(fam.flags)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_family(spark: SparkSession, path: str) -> HashFamily:
    meta = json.loads(spark.read.text(path).first()["value"])
    return family(meta["name"], meta["bits"], meta["ones"], **meta["flags"])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_index(spark: SparkSession, path: str, expect: HashFamily | None = None) -> tuple[DataFrame, HashFamily]:
    """The index and its family; another family than expected is refused, as its keys would lose matches."""
    grown = not exists(spark, f"{path}/family")  # by a stream: batches in folders, the family beside them
    fam = read_family(spark, f"{path}.family" if grown else f"{path}/family")
    if expect is not None and expect != fam:
        raise ValueError(f"the index was built with {fam}, not {expect}")
    return spark.read.parquet(path).drop("batch") if grown else spark.read.parquet(f"{path}/postings"), fam
