"""Readers of tables and their shredding into postings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.text import clean_text, lower_all

POSTING = ["table_id", "row_id", "col_id", "token"]


def read_csv(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """A CSV file with a header, all columns as text (so that 007 stays 007), in lower case."""
    df = spark.read.csv(path if path.endswith((".csv", "*", "/")) else f"{path}.csv", header=True, inferSchema=False, multiLine=True, escape='"')
    return lower_all(df) if lower else df


def read_csv_dir(spark: SparkSession, folder: str, clean: bool = False) -> DataFrame:
    """Postings of all CSV files of a folder with numeric names, whose headers are column numbers.

    Files differ in their columns, so all are read with as many as the widest header has; a file is read as a
    stream by one task (quoted cells may hold line feeds), and rows are numbered from 1 in its order. clean: tokens are
    cleaned as those of a query are by default; else they are in lower case. Cells without a header, rows
    shorter than it and empty cells give no postings.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.csv$", 1).cast("long")
    lines = spark.read.text(folder, pathGlobFilter="*.csv").select(name.alias("t"), F.monotonically_increasing_id().alias("i"), "value")
    heads = lines.groupBy("t").agg(F.min_by("value", "i").alias("value"))
    width = heads.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.csv(folder, schema=schema, pathGlobFilter="*.csv", multiLine=True, escape='"', quote='"', header=False)
    rows = rows.select(name.alias("table_id"), F.monotonically_increasing_id().alias("i"), F.array(*[f"c{i}" for i in range(width)]).alias("cells")).where("table_id is not null")
    head = rows.groupBy("table_id").agg(F.min_by("cells", "i").alias("head"), F.min("i").alias("first")).withColumnRenamed("table_id", "t")
    body = rows.join(head, F.col("table_id") == F.col("t")).where("i > first")
    cells = body.select("table_id", (F.col("i") - F.col("first")).alias("row_id"), F.explode(F.arrays_zip("head", "cells")).alias("z"))
    token = clean_text(F.col("z.cells")) if clean else F.lower("z.cells")
    out = cells.select("table_id", "row_id", F.expr("try_cast(trim(z.head) as int)").alias("col_id"), token.alias("token"))
    return out.where("token <> '' and col_id is not null").distinct()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Postings held in a database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*POSTING)


def shred(df: DataFrame, table_id: Column, row_id: Column, columns: Sequence[str], clean: bool = True, unique: bool = False) -> DataFrame:
    """One posting per cell: columns are numbered in the order given; empty cells are left out.

    Postings are distinct; unique=True says that row_id is unique, so that they are without a shuffle.
    """
    token = (lambda c: clean_text(F.col(c))) if clean else (lambda c: F.lower(F.col(c).cast("string")))
    wide = df.select(table_id.cast("long").alias("table_id"), row_id.cast("long").alias("row_id"), *[token(c).alias(str(i)) for i, c in enumerate(columns)])
    long = wide.unpivot(["table_id", "row_id"], [str(i) for i in range(len(columns))], "col_id", "token")
    out = long.where("token <> ''").select("table_id", "row_id", F.col("col_id").cast("int").alias("col_id"), "token")
    return out if unique else out.distinct()


def shred_rows(df: DataFrame, table_id: Column, row_id: Column, columns: Sequence[str], clean: bool = True) -> DataFrame:
    """(table_id, row_id, cells) for each row: the postings of shred() as they stand in it, ascending by column, or none; row_id may repeat."""
    token = (lambda c: clean_text(F.col(c))) if clean else (lambda c: F.lower(F.col(c).cast("string")))
    wide = df.select(table_id.cast("long").alias("table_id"), row_id.cast("long").alias("row_id"), *[token(c).alias(f"_{i}") for i, c in enumerate(columns)])
    cell = lambda i: F.when(F.col(f"_{i}") != "", F.struct(F.lit(i).alias("col_id"), F.col(f"_{i}").alias("token")))
    return wide.select("table_id", "row_id", F.array_compact(F.array(*[cell(i) for i in range(len(columns))])).alias("cells"))


def union_postings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
