"""A quality classifier: boosted trees over statistics of a whole text.

The statistics come from a byte histogram a text and the hashes and lengths of its words and lines, all as array operations on
batches of UTF-8 bytes. Rows to learn from are bounded by a parameter; every row is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, sliced, utf8
from .gbt import Trees, fit
from .words import words

#: Groups of bytes whose shares are statistics.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",", "!", "?", "|", "*", "$", "%", "&", "#", "\"'`", ":;", "-_", "()[]{}<>", "/\\@", "=+^~"]


def _group_table() -> np.ndarray:
    out = np.zeros((256, len(GROUPS) + 1))
    for k, g in enumerate(GROUPS):
        out[[ord(c) for c in g], k] = 1
    out[128:, -1] = 1
    return out


TABLE = _group_table()
N_FEATURES = TABLE.shape[1] + 13


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    histogram = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    share = histogram / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    w = words(data, offsets)
    count = np.diff(w.first)
    many = np.maximum(count, 1)
    length = w.end - w.begin
    per_doc = lambda x: np.bincount(w.doc, x, n) / many
    order = np.lexsort((w.hashes, w.doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][fresh], minlength=n) / many
    starts = np.zeros(len(data), bool)
    starts[1:] = data[:-1] == 10
    starts[offsets[:-1][size > 0]] = True
    lines = np.bincount(doc[starts], minlength=n)
    upper = (data >= 65) & (data <= 90)
    again = np.append(False, (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1]))[: len(w.doc)]  # the same word once more
    lead = upper[w.begin] if len(w.begin) else np.empty(0, bool)
    second = upper[np.minimum(w.begin + 1, max(len(data) - 1, 0))] & (length > 1) if len(w.begin) else np.empty(0, bool)
    more = [np.log1p(size), np.log1p(count), entropy, per_doc(length), np.sqrt(np.maximum(per_doc(length**2.0) - per_doc(length) ** 2, 0)), per_doc(length <= 3), per_doc(length >= 12), per_doc(lead), per_doc(second), per_doc(again), distinct, np.log1p(lines), size / np.maximum(lines, 1)]
    return np.column_stack([share @ TABLE, *more])


def _featured(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = statistics(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *[batch.column(c) for c in columns]], names=["features", *columns])

    return run


def _scored(trees: Trees) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = trees.score(statistics(*utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=[*batch.schema.names, "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by a checksum of their text; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Trees:
    """Learn ``quality`` from ``rows`` labelled documents outside the held-out fifth, chosen by a hash of their ids.

    Labels other than 0 and 1, and null ids, aren't learnt from; a null text is an empty one; a document with several labels, or an
    id that repeats, counts once for each. Without documents of both labels, the score is their share (one half without any).
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = own.orderBy(F.xxhash64("doc_id"), "quality").limit(rows)  # so many rows, whatever the input
    joined = documents(docs).join(F.broadcast(sample), "doc_id")
    got = joined.select("text", "doc_id", "quality").mapInArrow(_featured(["doc_id", "quality"]), "features array<double>, doc_id long, quality int").toPandas()
    got = got.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(got["features"].tolist(), float).reshape(len(got), N_FEATURES)
    return fit(x, got["quality"].to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, higher for likelier good texts. docs: text, any others.

    A null text is scored as an empty one, and an empty one like texts without words. Repeated rows get equal scores. An empty
    table gives no rows. A column named score is replaced.
    """
    own = docs.drop("score").withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    return own.mapInArrow(_scored(trees), T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())]))
