"""A training corpus from `documents`: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. The last returns where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.common import cut, table
from keyloom.llm.decontam import decontam_stage
from keyloom.llm.mixing import mix_stage
from keyloom.llm.neardup import near_dedup_stage
from keyloom.llm.quality import quality_stage
from keyloom.llm.sharding import shard_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontam_stage),
    ("mixing", mix_stage),
    ("sharding", shard_stage),
]

#: SQL has no components of near copies; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
