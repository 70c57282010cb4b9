"""What the operators share: tables in the shared folder, batch sizes, row packing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts end at these bytes (ASCII white space only).
WORD_GAP = r"[\x20\x09-\x0D]+"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A batch ends at the row that takes it to this size.
BATCH_BYTES = 4 << 20

#: A key is hot with more than one in so many rows.
HOT = 1000
SALTS = 64

#: Words of 64 bits of a filter that is broadcast.
FILTER_WORDS = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="keyloom-")
    atexit.register(shutil.rmtree, base, True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so that lineage ends there.

    The shuffle files of the write go as it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the table behind a frame from cut() that no later plan reads."""
    files = df.inputFiles()
    for spark, path in [x for x in _written if files and x[1].split("/")[-1] in files[0]]:
        _delete(spark, path)
        _written.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


def lean_batches(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches, in rows and in bytes: texts can be long, and a Python worker holds a batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(rows: DataFrame, side: DataFrame, on: list[tuple[str, str]], size: str, total: int, unmatched: bool = False, number: str | None = None) -> DataFrame:
    """The rows with a match (unmatched: all rows), each with the other columns of the one row of `side` that has its key (null-safe).

    `size` says how many of the `total` rows have the key. A key with more than 1/HOT of all rows would fill one task
    of a shuffled join: there are fewer than HOT of these, whatever the input, so they are broadcast, and in the join
    with the rest their rows are spread by a salt. rows names no column like those of side, and has its rows in the same
    order when a lost task runs again (a scan, or a join by unique keys), since the salt is a running number; else `number`
    names a column with numbers that were given to the rows where that held.
    """
    met = lambda names: reduce(lambda a, b: a & b, [rows[a].eqNullSafe(F.col(b)) for (a, _), b in zip(on, names, strict=True)])
    kept = [c for c in side.columns if c != size and c not in {b for _, b in on}]
    hot = F.col(size) * HOT > F.lit(total)
    few = side.where(hot).select(*[F.col(b).alias(f"_hot{i}") for i, (_, b) in enumerate(on)], F.struct(*kept).alias("_few"))
    rest = side.where(~hot).select(*[F.col(b).alias(f"_key{i}") for i, (_, b) in enumerate(on)], F.struct(*kept).alias("_rest"), F.lit(0).cast("long").alias("_none"))
    salt = F.when(F.col("_few").isNull(), 0).otherwise(1 + F.pmod(F.col(number) if number else F.monotonically_increasing_id(), F.lit(SALTS)))
    out = rows.join(F.broadcast(few), met([f"_hot{i}" for i in range(len(on))]), "left").withColumn("_salt", salt.cast("long"))
    out = out.join(rest, met([f"_key{i}" for i in range(len(on))]) & (F.col("_salt") == F.col("_none")), "left")
    out = out.withColumn("_side", F.coalesce("_few", "_rest"))
    out = out if unmatched else out.where("_side is not null")
    return out.select(*[f"`{c}`" for c in rows.columns], "_side.*")


def possible(rows: DataFrame, keys: DataFrame, names: list[str], found: bool = True) -> DataFrame:
    """Rows whose columns `names` may be among those of keys, or (found=False) are not for certain.

    A Bloom filter in a table of FILTER_WORDS words at most, which is broadcast: only rows that pass need to move for
    the exact join with the keys. When the filter is full all rows pass, and the join is as it would be without.
    """
    h = F.xxhash64(*names)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    word, bits = F.shiftrightunsigned(h, 18).bitwiseAND(F.lit(FILTER_WORDS - 1)), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))
    words = keys.select(word.alias("_w"), bits.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    met = rows.join(F.broadcast(words), word == F.col("_w"), "left")
    within = F.coalesce(F.col("_b").bitwiseAND(bits) == bits, F.lit(False))
    return met.where(within if found else ~within).drop("_w", "_b")


def unit_draw(*parts: Column) -> Column:
    """A uniform number in (0, 1) that the values alone decide."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(2**53))


def pack(docs: DataFrame) -> DataFrame:
    """All columns in one struct `row`, so that no name can clash with a computed one."""
    return docs.select(F.struct("*").alias("row"))


def unpack(df: DataFrame) -> DataFrame:
    return df.select("row.*")
