"""Near-duplicate texts: a Jaccard join on sets of word n-grams, by MinHash banding with exact verification.

1. Every text gets one MinHash signature, cut into bands. Bands and rows are chosen for a recall at the threshold. Equal texts
   are one class from here on, known by a 128-bit digest, and only one of them is looked at again.
2. Classes are shuffled on their band hashes. In a bucket each class is tied to the least one, not to every other, so a bucket of
   m classes makes m - 1 ties. Connected ties form clusters; two classes that share any bucket are in one cluster.
3. A cluster's full shingle sets meet in one task, or, in a large one, in a task for each two of its blocks. There all pairs are
   compared on full sets, as a product of matrices over groups of shingles that the same texts hold. What comes out is one row a class
   and task: how many documents it is linked with, and the least class that links lead to.
4. Links in a cluster of one block are its components; those of several blocks are joined by the component fixpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._common import documents, drop_table, materialize, mix, sliced, utf8
from .words import SHINGLE, shingles, words


def banding(similarity: float = 0.8, recall: float = 0.9999, most: int = 256) -> tuple[int, int]:
    """Bands and rows: the most rows a band for which so many hashes still reach the recall at the similarity."""
    fits = [(int(np.ceil(np.log(1 - recall) / np.log1p(-(similarity**r)))), r) for r in range(1, 17)]
    return max((f for f in fits if f[0] * f[1] <= most), key=lambda f: f[1], default=fits[0])


def band_hashes(sh: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """documents x bands; documents without shingles have zeros."""
    n = len(first) - 1
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((n, bands), np.uint64)
    if not len(full):
        return out
    x, starts = (sh >> np.uint64(32)).astype(np.uint32), first[:-1][full]
    keys = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for b in range(bands):
        h = np.full(len(full), b + 1, np.uint64)
        for k in keys[b * rows : (b + 1) * rows]:
            flip, times = np.uint32(k >> np.uint64(32)), np.uint32(k) | np.uint32(1)
            h = mix(h + np.minimum.reduceat((x ^ flip) * times, starts))
        out[full, b] = h
    return out


def _signed(bands: int, rows: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            w = words(data, offsets)
            sh, first = shingles(w, data, offsets, size)
            found = band_hashes(sh, first, bands, rows).view(np.int64)
            held = np.diff(first) > 0
            at = np.append(0, np.cumsum(np.where(held, bands, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(at), pa.array(found[held].ravel()))], names=["doc_id", "key", "bytes", "bands"])

    return run


def intersections(sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and of all their intersections, for documents with shingles ``sh[first[d]:first[d + 1]]``."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((doc, sh))
    sh, doc = sh[order], doc[order]
    fresh = np.ones(len(sh), bool)
    fresh[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    sh, doc = sh[fresh], doc[fresh]
    sizes = np.bincount(doc, minlength=n)
    both = np.zeros((n, n), np.float32)
    if not len(sh):
        return sizes, both
    starts = np.flatnonzero(np.append(True, sh[1:] != sh[:-1]))
    held = np.diff(np.append(starts, len(sh)))
    # Shingles that the same documents hold are one column, with their number as its weight.
    marks = mix(np.arange(1, n + 1, dtype=np.uint64))
    group, index, weight = np.unique(np.add.reduceat(marks[doc], starts)[held > 1], return_index=True, return_counts=True)
    starts, held = starts[held > 1][index], held[held > 1][index]
    for at in range(0, len(group), 4096):
        s, h = starts[at : at + 4096], held[at : at + 4096]
        a = np.zeros((n, len(s)), np.float32)
        column = np.repeat(np.arange(len(s)), h)
        a[doc[np.repeat(s - np.append(0, np.cumsum(h)[:-1]), h) + np.arange(h.sum())], column] = 1
        both += (a * weight[at : at + 4096].astype(np.float32)) @ a.T
    return sizes, both


def _linked(sizes: np.ndarray, both: np.ndarray, percent: int, side: np.ndarray | None) -> np.ndarray:
    """Pairs whose Jaccard similarity is at least percent / 100; with ``side``, only pairs across."""
    shared = np.rint(both).astype(np.int64)
    out = (100 + percent) * shared >= percent * (sizes[:, None] + sizes[None, :])
    out &= shared > 0
    np.fill_diagonal(out, False)
    if side is not None:
        out &= side[:, None] != side[None, :]
    return out


def _least(linked: np.ndarray) -> np.ndarray:
    """The least index that links lead to, for each."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(percent: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by cluster, i, j, block, key; the rows of a unit (cluster, i, j) are compared with one another."""
    names = ["key", "least", "links", "blocks"]

    def unit(rows: list[dict]) -> pa.RecordBatch | None:
        rows = list({r["key"]: r for r in rows}.values())
        data, offsets = utf8(pa.array([r["text"] for r in rows], pa.large_string()))
        sh, first = shingles(words(data, offsets), data, offsets, size)
        side = np.array([r["block"] for r in rows])
        linked = _linked(*intersections(sh, first), percent, side if rows[0]["i"] != rows[0]["j"] else None)
        hit = np.flatnonzero(linked.any(axis=1))
        if not len(hit):
            return None
        least, count = _least(linked), linked @ np.array([r["copies"] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows[k]["key"] for k in hit], pa.binary()), pa.array([rows[least[k]]["key"] for k in hit], pa.binary()), pa.array(count[hit]), pa.array([rows[k]["blocks"] for k in hit], pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in sliced(batches, "text"):
            for r in batch.to_pylist():
                if held and (r["cluster"], r["i"], r["j"]) != (held[0]["cluster"], held[0]["i"], held[0]["j"]):
                    if (out := unit(held)) is not None:
                        yield out
                    held = []
                held.append(r)
        if held and (out := unit(held)) is not None:
            yield out

    return run


def _classes(docs: DataFrame, percent: int, size: int, recall: float, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key (a digest of the text) of each document; and key, doc_id (the least), copies, links, root (a key of its class) of each text."""
    bands, rows = banding(percent / 100, recall)
    own = documents(docs).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.lower("text").alias("text"))
    signed = materialize(own.mapInArrow(_signed(bands, rows, size), "doc_id long, key binary, bytes long, bands array<long>"), "signatures")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("bytes").alias("bytes"))

    in_bands = signed.select("key", F.explode("bands").alias("band"))
    least = in_bands.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most").select("band", "least")
    ties = in_bands.join(least, "band").where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    rooted = components(ties)
    members = rooted.select(F.col("root").alias("cluster"), F.col("node").alias("key")).unionByName(rooted.select(F.col("root").alias("cluster"), F.col("root").alias("key")).distinct())
    members = materialize(members.join(classes, "key"), "members")
    weight = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("blocks"))
    placed = members.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    text = own.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "text")
    found = text.join(placed.hint("merge"), (F.col("of_key") == F.col("key")) & F.col("of").eqNullSafe(F.col("doc_id")))
    units = found.select("cluster", "key", "copies", "blocks", "block", "text", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    units = units.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "blocks", "text")
    dealt = units.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "key")
    links = materialize(dealt.mapInArrow(_verified(percent, size), "key binary, least binary, links long, blocks int"), "links")
    drop_table(members)

    wide = components(links.where("blocks > 1").select(F.col("key").alias("a"), F.col("least").alias("b")))
    root = links.where("blocks = 1").select("key", F.col("least").alias("root")).unionByName(wide.select(F.col("node").alias("key"), "root"))
    root = root.unionByName(wide.select(F.col("root").alias("key"), "root").distinct())
    total = links.groupBy("key").agg(F.sum("links").alias("links")).join(root, "key", "left")
    rated = materialize(classes.join(total, "key", "left").select("key", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root")), "classes")
    return signed, rated


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE, recall: float = 0.9999, block: int = 512, block_bytes: int = 32 << 20) -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id that links lead to), n_links (documents it is linked with),
    n_copies (documents of equal text, itself among them).

    Documents are linked if their sets of ``size``-word shingles (runs of letters, digits and other non-ASCII characters,
    lower-cased) have a Jaccard similarity of at least ``percent`` %, or their texts are equal. Texts with fewer words
    have one shingle. docs: doc_id, text. A null text is an empty one; empty texts are copies of one another. Rows with a
    null doc_id are documents, and rows that repeat a doc_id too; a class of null ids alone has a null id. An empty table
    gives no rows. Other columns are left out.
    """
    signed, rated = _classes(docs, percent, size, recall, block, block_bytes)
    named = rated.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    every = rated.join(named, "root").select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return signed.select("doc_id", "key").join(every, "key").select("doc_id", "class_id", "n_links", "n_copies")


def first_of_each(docs: DataFrame, percent: int = 80, size: int = SHINGLE, recall: float = 0.9999, block: int = 512, block_bytes: int = 32 << 20) -> DataFrame:
    """One row of ``docs`` of each class of ``near_duplicates``: of its least doc_id (null ids come last, then texts go by their digests). Of rows
    equal in doc_id and text the one with the least other columns stays, so these must have an order. All columns stay.
    """
    signed, rated = _classes(docs, percent, size, recall, block, block_bytes)
    least = rated.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("f")).select(F.col("f.doc_id").alias("of"), F.col("f.key").alias("of_key"))
    met = signed.join(least, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")))
    first = materialize(met.groupBy("of", "of_key").agg(F.count("*").alias("rows")), "first")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    keyed = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("key"))

    def met_by(rows: DataFrame) -> DataFrame:
        return keyed.join(rows, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")))

    out = met_by(first.where("rows = 1").hint("merge")).select("whole.*")
    repeated = first.where("rows > 1")
    if repeated.isEmpty():
        return out
    return out.unionByName(met_by(repeated).groupBy("of", "of_key").agg(F.min("whole").alias("whole")).select("whole.*"))
