"""Growing an index as tables arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.functions.hashing import HashFamily
from keyloom.operators.index import build_index, exists, read_family, write_family


def append_to_index(postings: DataFrame, fam: HashFamily, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index a stream of postings in micro-batches; a row's postings must arrive together.

    A batch is written to a folder of its own, so that a repeated batch replaces itself. The family is written beside
    the folder, and read_index() reads both; a stream with another family is refused.
    """
    spark = postings.sparkSession
    if exists(spark, f"{path}.family"):
        if (known := read_family(spark, f"{path}.family")) != fam:
            raise ValueError(f"the index was built with {known}, not {fam}")
    else:
        write_family(spark, fam, f"{path}.family")

    def write(batch: DataFrame, number: int) -> None:
        build_index(batch, fam).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = postings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
