"""Huffman codes of a table of symbol counts."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols that a code is built for at most: the tree is built on the driver.
MAX_SYMBOLS = 100_000


def huffman(frequency: Mapping[str, int]) -> list[tuple[str, str]]:
    """(symbol, code), shortest first; a single symbol has the empty code."""
    parent: dict[int, tuple[int, str]] = {}
    symbols = sorted(frequency)
    heap = [(frequency[s], s, i) for i, s in enumerate(symbols)]
    heapq.heapify(heap)
    node = len(heap)
    while len(heap) > 1:
        (w0, s0, a), (w1, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (node, "0"), (node, "1")
        heapq.heappush(heap, (w0 + w1, s0, node))  # ties go by the first symbol of the lighter part
        node += 1

    def code(i: int) -> str:
        bits = []
        while i in parent:
            i, bit = parent[i]
            bits.append(bit)
        return "".join(reversed(bits))

    return sorted(((s, code(i)) for i, s in enumerate(symbols)), key=lambda x: (len(x[1]), x[0]))


def huffman_codes(df: DataFrame, column: str, max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """(symbol, n, code) of a column's values; refuses more symbols than the driver may hold."""
    counts = df.groupBy(F.col(column).alias("symbol")).agg(F.count("*").alias("n")).where("symbol is not null")
    rows = counts.limit(max_symbols + 1).collect()
    if len(rows) > max_symbols:
        raise ValueError(f"over {max_symbols} symbols")
    n = {r["symbol"]: r["n"] for r in rows}
    codes = huffman(n) if n else []
    return df.sparkSession.createDataFrame([(s, n[s], c) for s, c in codes], "symbol string, n long, code string")
