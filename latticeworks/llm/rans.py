"""Token ids in compressed binary blocks: a static range asymmetric numeral system with shared frequencies.

A store is three Parquet tables, so that it can be written to and read from whatever Spark reaches:

- ``blocks``: part, block, first (ids before it in its part), n_ids, doc_ids, doc_lens, payload;
- ``parts``: part, n_ids, before (ids in all parts before it), in ascending order of documents;
- ``frequencies``: bits, freq (one entry an id; they add up to 2**bits), end_id.

A payload is little-endian: magic ``LWR1``, then unsigned 32-bit counts of ids, lanes, steps between checkpoints, checkpoints and
words; for each checkpoint its word offset (32 bits) and its lanes' states (64 bits); the words (32 bits); and the CRC-32 of all before it.
Ids are dealt to the lanes in turn. Blocks don't depend on one another, and each checkpoint is a place to begin at: decoders may
work on any block, or from any checkpoint within one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, drop_table, materialize, parallelism, release, sliced
from .tokens import encoder, local_path

MAGIC, HEAD = b"LWR1", struct.Struct("<4s5I")
#: States stay in LOW .. LOW * 2**32, and words of 32 bits leave and enter.
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


def quantize(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that add up to 2**bits, in proportion to ``counts``, at least 1 where there is a count."""
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        out[0] = 1 << bits
        return out
    if len(seen) > 1 << bits:
        raise ValueError("more ids in use than frequencies can tell apart")
    spare = (1 << bits) - len(seen)
    share = counts[seen] * (spare / counts[seen].sum())
    own = np.floor(share).astype(np.int64)
    own[np.argsort(own - share, kind="stable")[: spare - own.sum()]] += 1  # the largest remainders
    out[seen] = own + 1
    return out


@dataclass
class Coder:
    freq: np.ndarray
    bits: int

    def __post_init__(self) -> None:
        freq = np.asarray(self.freq, np.uint64)
        self.f, self.below = freq, np.cumsum(freq) - freq
        self.limit = (LOW >> np.uint64(self.bits) << WORD) * freq
        self.symbols: np.ndarray | None = None

    def encode(self, ids: np.ndarray, lanes: int = 2048, every: int = 64) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n))
        steps = -(-n // lanes)
        padded = np.full(steps * lanes, int(np.argmax(self.f)), np.int64)
        padded[:n] = ids
        rows, bits = padded.reshape(steps, lanes), np.uint64(self.bits)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        kept: list[tuple[int, np.ndarray]] = []  # states before a step, with the words that decoders read from it on
        total = 0
        for t in range(steps - 1, -1, -1):
            s = rows[t]
            f = self.f[s]
            if (over := x >= self.limit[s]).any():
                words.append(x[over].astype("<u4"))
                total += len(words[-1])
                x = np.where(over, x >> WORD, x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.below[s]
            if t % every == 0:
                kept.append((total, x))
        points = b"".join(struct.pack("<I", total - at) + state.astype("<u8").tobytes() for at, state in reversed(kept))
        body = HEAD.pack(MAGIC, n, lanes, every, len(kept), total) + points + b"".join(w.tobytes() for w in reversed(words))
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, payload: bytes, checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
        """The ids from ``checkpoint`` on, through so many checkpoints (all)."""
        magic, n, lanes, every, count, total = HEAD.unpack_from(payload)
        if magic != MAGIC or len(payload) < HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("a block of ids is damaged")
        if not n:
            return np.empty(0, np.int64)
        if self.symbols is None:
            self.symbols = np.repeat(np.arange(len(self.f)), self.f.astype(np.int64))
        size = 4 + 8 * lanes
        words = np.frombuffer(payload, "<u4", total, HEAD.size + count * size)
        last = min(count, checkpoint + (checkpoints or count))
        steps = min(-(-n // lanes), last * every) - checkpoint * every
        at = HEAD.size + checkpoint * size
        pos = struct.unpack_from("<I", payload, at)[0]
        x = np.frombuffer(payload, "<u8", lanes, at + 4).astype(np.uint64)
        out = np.empty((steps, lanes), np.int64)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        for t in range(steps):
            slot = x & mask
            s = out[t] = self.symbols[slot]
            x = self.f[s] * (x >> bits) + slot - self.below[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << WORD) | words[pos : pos + len(low)]
                pos += len(low)
        return out.ravel()[: n - checkpoint * every * lanes]


_RAW = "part int, block int, first long, doc_ids array<long>, doc_lens array<long>, ids binary"


#: The number of a part's last row, which has its ids' counts in place of documents.
COUNTS = -1


def _raw_blocks(path: str, dtype: str, end_id: int, block_ids: int, vocabulary: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of a part, in order, as blocks of whole documents with some ``block_ids`` ids; then a row of counts."""
    width, end = np.dtype(dtype).itemsize, np.array([end_id], dtype).tobytes()
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = encoder(path, dtype), 0
        block, first, size = 0, 0, 0
        docs, lens, own = [], [], []
        counts = np.zeros(vocabulary, np.int64)

        def row(*values: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)

        def made() -> pa.RecordBatch:
            data = b"".join(own)
            counts[:] += np.bincount(np.frombuffer(data, dtype), minlength=vocabulary)
            return row(part, block, first, docs, lens, data)

        for batch in sliced(batches, "text"):
            for doc, ids, own_part in zip(batch.column("doc_id").to_pylist(), tokenizer.all_ids(batch.column("text").to_pylist()), batch.column("part").to_pylist()):
                if own_part != part:
                    if docs:
                        yield made()
                    part, block, first, size = own_part, 0, 0, 0
                    docs, lens, own = [], [], []
                ids += end
                docs.append(doc)
                own.append(ids)
                lens.append(len(ids) // width)
                size += lens[-1]
                if size >= block_ids:
                    yield made()
                    block, first, size = block + 1, first + size, 0
                    docs, lens, own = [], [], []
        if docs:
            yield made()
        seen = np.flatnonzero(counts)
        yield row(part, COUNTS, 0, seen, counts[seen], b"")

    return run


def _coded(dtype: str, freq: np.ndarray, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, bits)
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("part", "block", "first")] + [pa.array([len(x) for x in ids], pa.int64()), batch.column("doc_ids"), batch.column("doc_lens"), pa.array([coder.encode(x) for x in ids], pa.binary())],
                names=["part", "block", "first", "n_ids", "doc_ids", "doc_lens", "payload"],
            )

    return run


def _slot(column: Column, cuts: list[float], first: int = 0) -> Column:
    """How many of the sorted cuts a value is above, as a tree of comparisons."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(column <= cuts[mid], _slot(column, cuts[:mid], first)).otherwise(_slot(column, cuts[mid + 1 :], first + mid + 1))


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and part: parts hold ranges of ids, null ids first, and lie whole in a task, in order. The ranges come from the ids
    alone, so texts are read once."""
    own, tasks = documents(docs), parallelism(docs)
    slots = min(4 * tasks, 4096)
    cuts = sorted(set(own.approxQuantile("doc_id", [k / slots for k in range(1, slots)], 1 / (4 * slots))))
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(_slot(F.col("doc_id"), cuts))
    return own.withColumn("part", part.cast("int")).repartition(tasks, "part").sortWithinPartitions("part", "doc_id", F.xxhash64("text"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 1 << 19, bits: int = 20) -> None:
    """Encode each text, append ``end_id``, and write all ids to a store at ``path``, in ascending order of doc_id.

    A null text is an empty one, and has its end id alone. Null doc_ids come first; rows that repeat a doc_id follow one
    another. An empty table makes a store without blocks. A block holds whole documents: ``block_ids`` ids and at most one document more.
    """
    place = local_path(tokenizer)
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(place).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    raw = materialize(_in_order(docs).mapInArrow(_raw_blocks(place, dtype, end_id, block_ids, vocabulary), _RAW), "ids")
    release(spark)
    own = raw.where(F.col("block") == COUNTS).select(F.explode(F.arrays_zip("doc_ids", "doc_lens")).alias("c"))
    counted = own.groupBy(F.col("c.doc_ids").alias("id")).agg(F.sum("c.doc_lens").alias("n")).collect()  # a row an id of the vocabulary at most
    counts = np.zeros(vocabulary, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    freq = quantize(counts, bits)
    spark.createDataFrame([(bits, freq.tolist(), end_id)], "bits int, freq array<long>, end_id long").coalesce(1).write.parquet(f"{path}/frequencies")
    raw.where(F.col("block") != COUNTS).mapInArrow(_coded(dtype, freq, bits), "part int, block int, first long, n_ids long, doc_ids array<long>, doc_lens array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    drop_table(raw)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts.withColumn("before", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).coalesce(1).write.parquet(f"{path}/parts")  # a row a part


def _decoded(freq: np.ndarray, bits: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, bits)
        for batch in batches:
            for r in batch.to_pylist():
                data = coder.decode(r["payload"]).astype("<u4").tobytes()
                at, rows = 0, []
                for doc, n in zip(r["doc_ids"], r["doc_lens"]):
                    own = data[4 * at : 4 * (at + n)]
                    rows.append((doc, r["start"] + at, n, zlib.crc32(own), own if keep_ids else None))
                    at += n
                if 4 * at != len(data):
                    raise ValueError("a block's documents don't add up to its ids")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_ids(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit integers; null without
    ``keep_ids``). A damaged block raises an error."""
    table = spark.read.parquet(f"{path}/frequencies").first()
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/parts").select("part", "before"), "part")
    return blocks.select((F.col("before") + F.col("first")).alias("start"), "doc_ids", "doc_lens", "payload").mapInArrow(
        _decoded(np.array(table["freq"], np.int64), table["bits"], keep_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
