"""Harmonic packing of tokenized documents into sequences of fixed capacity.

A document's ids are cut into pieces of the sizes capacity/1, capacity/2, ... capacity/`finest` (whole sequences first, then
the largest that fits), and a tail shorter than capacity/finest. A piece of length n is of class j = capacity // n, so that
any j pieces of class j fit one sequence: bins of class j are filled with exactly j pieces, class by class, by rank alone,
with no search and no talk between workers. Bins of cut sizes have less than j empty places; those of tails less than
1/finest of the capacity. The one open bin of each class (a bound that doesn't grow with the data) is emptied into a last set
of bins by first fit.

Ranks are a worker's own ranks plus the counts of the workers before it, from a table of one row a worker and class.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, materialize, sliced
from .tokens import encoder, local_path

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("worker", pa.int32()), ("class", pa.int32()), ("rank", pa.int64())])


def cut(n: int, capacity: int, finest: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out, n = [capacity] * (n // capacity), n % capacity
    while n * finest >= capacity:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out + [n] * (n > 0)


def _pieces(path: str, end_id: int, capacity: int, finest: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES.append(pa.field("ids", pa.binary())) if keep_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, worker, ranks = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in sliced(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.all_ids(batch.column("text").to_pylist())):
                ids += end
                start, total = 0, len(ids) // 4
                for n in cut(total, capacity, finest):
                    own, j = ids[4 * start : 4 * (start + n)], capacity // n
                    rows.append((doc, start, n, zlib.crc32(own), total, worker, j, ranks[j], *([own] if keep_ids else [])))
                    ranks[j] += 1
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _first_fit(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "worker", "rank"], ascending=[False, True, True, True, True], ignore_index=True)
        fill: list[int] = []
        bins, offsets = [], []
        for n in rows["length"]:
            at = next((k for k, x in enumerate(fill) if x + n <= capacity), len(fill))
            if at == len(fill):
                fill.append(0)
            bins.append(at)
            offsets.append(fill[at])
            fill[at] += n
        return rows.assign(sequence_id=[k * 2 * capacity for k in bins], offset=offsets)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, finest: int = 16, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned
    32-bit integers) with ``keep_ids``.

    docs: doc_id, text. A null text is an empty one, and has its end id alone. A null doc_id, and rows that repeat one, are
    packed like any other row. An empty table gives no rows. Texts of any length are cut; other columns are left out.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, class int, rank long" + ", ids binary" * keep_ids
    made = materialize(documents(docs).mapInArrow(_pieces(local_path(tokenizer), end_id, capacity, finest, keep_ids), schema), "pieces")
    own = made.groupBy("worker", "class").agg(F.count("*").alias("n"))
    before = own.select("worker", "class", (F.sum("n").over(Window.partitionBy("class").orderBy("worker")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("class")).alias("of_class"))
    j, rank = F.col("class"), F.col("rank") + F.col("before")
    ranked = made.join(before, ["worker", "class"]).withColumn("rank", rank).withColumn("bin", F.expr("rank div class"))
    full = F.col("bin") < F.expr("of_class div class")
    named = ranked.withColumn("sequence_id", F.col("bin") * (2 * capacity) + j)
    cuts = named.where(full & (j < finest)).withColumn("offset", (F.col("rank") % j) * F.col("length"))
    tails = named.where(full & (j >= finest)).withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("rank")) - F.col("length"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    rest = ranked.where(~full).groupBy(F.lit(0).alias("one")).applyInPandas(_first_fit(capacity), ranked.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long")
    return cuts.select(columns).unionByName(tails.select(columns)).unionByName(rest.select(columns))


