"""Token counts from a table of distinct pre-tokens.

No piece of the vocabulary crosses a gap between a non-space and a space, or touches a line feed from
inside (checked when the model is loaded), so a text may be cut there and its count is the sum over the
pieces cut: pre-tokens, each a run of spaces or one line feed with what follows. Each distinct pre-token is
encoded once. Documents keep frequencies of pre-tokens, not ids.

The HEAD most frequent pre-tokens of at most HEAD_CHARS characters, and HEAD / 20 longer ones of at most LONG (a bounded
table), are broadcast and looked up where a document is read. Longer ones yet are counted there. All others go as (row, pre-token, frequency) through a
join with the counts, so nothing that grows with the corpus is broadcast, and no count is estimated.

Defined cases: null and empty texts have no tokens; repeated rows are counted each (rows carry a number
of their own); null ids stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean_batches, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: The head: so many of the most frequent pre-tokens of up to HEAD_CHARS characters, and a twentieth as many longer ones.
HEAD = 200_000
HEAD_CHARS = 24
#: A pre-token of more characters is counted where it is read: it is rare, and no key of a shuffle.
LONG = 1000
#: Distinct pre-tokens, and characters of them, that a task gathers before it passes them on.
GATHER, GATHER_CHARS = 300_000, 16 << 20
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model; refused if texts cannot be cut as pre_tokens() cuts them."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if SPACE in p.lstrip(SPACE) or "\n" in p:
            raise ValueError(f"piece {p!r} crosses a cut between pre-tokens")
    if sp.encode("a  b") != sp.encode("a") + sp.encode(" b") or len(sp.encode("\n")) != 2:
        raise ValueError("the model changes spaces or line feeds")
    return sp


def pre_tokens(text: str) -> list[str]:
    """Each begins with spaces or with a line feed; joined they are the text after one space."""
    return re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text.replace(SPACE, " ")) if text else []


def count_pieces(sp, tokens: list[str]) -> list[int]:
    """The encoder puts a space before any text: it stands for the first space, and is taken off before a line feed."""
    found = sp.encode([t[1:] if t[0] == " " else t for t in tokens], num_threads=1)
    return [1 if t == " " else len(ids) - (t[0] == "\n") for t, ids in zip(tokens, found, strict=True)]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["token", "n"])

    seen: Counter = Counter()
    chars = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(t for t in pre_tokens(text) if len(t) <= LONG)
                chars += len(text)  # at least the characters of what is new
            if len(seen) > GATHER or (chars > GATHER_CHARS and (chars := sum(map(len, seen))) > GATHER_CHARS):
                yield out(seen)
                seen, chars = Counter(), 0
    yield out(seen)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(path)
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count_pieces(sp, tokens) if tokens else [], pa.int32())], ["token", "n", "pieces"])

    return run


PARTS = "rid long, doc_id long, n_bytes long, n long, token string"


def _splitter(shared, path: str):
    """(rid, doc_id, text) to one row per document with the sum over the head, and one per other pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sp = shared.value, load(path)
        for batch in batches:
            rid, doc, size, n, token = [], [], [], [], []
            for r, d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, total = text or "", 0
                for t, k in Counter(pre_tokens(text)).items():
                    if (own := head.get(t)) is not None:
                        total += k * own
                    elif len(t) > LONG:
                        total += k * count_pieces(sp, [t])[0]
                    else:
                        rid.append(r), doc.append(None), size.append(None), n.append(k), token.append(t)
                rid.append(r), doc.append(d), size.append(len(text.encode())), n.append(total), token.append(None)
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((rid, doc, size, n, token), kinds, strict=True)], ["rid", "doc_id", "n_bytes", "n", "token"])

    return run


def piece_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(token, n, pieces): each distinct pre-token of all documents, its frequency and its number of pieces."""
    found = docs.select(text).mapInArrow(_gather, "token string, n long")
    return cut(found.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(_encoder(path), "token string, n long, pieces int"))


def count_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    spark = docs.sparkSession
    lean_batches(spark)
    pieces = piece_table(docs, path, text)
    short = F.length("token") <= HEAD_CHARS
    best = lambda rows, n: rows.orderBy(F.desc("n"), "token").limit(n).select("token", "pieces")
    top = best(pieces.where(short), head).union(best(pieces.where(~short), head // 20)).toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = cut(rows.mapInArrow(_splitter(shared, path), PARTS))
    rest = parts.where("token is not null").select("rid", "token", "n")
    tail = rest.join(pieces.select("token", "pieces"), "token").groupBy("rid").agg(F.sum(F.col("n") * F.col("pieces")).alias("tail"))
    docs_ = parts.where("token is null").select("rid", "doc_id", "n_bytes", "n")
    return docs_.join(tail, "rid", "left").select("doc_id", "n_bytes", (F.col("n") + F.coalesce("tail", F.lit(0))).alias("n_tokens"))


def op6_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
