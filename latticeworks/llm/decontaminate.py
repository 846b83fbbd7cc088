"""Benchmark decontamination: every passage of every document is a query to a BM25 index of the test items.

Entries of the index are items, and their questions (all sentences but the last) and answers (the last sentence) of enough words. Weights come
from counts over all items, so that neither scores nor results depend on how items are dealt to shards. Scores are shares of an entry's own
score, so one threshold serves all entries. Entries are sorted into classes by their length in words, and a class has a length of chunk
that any of its entries fits; passages are two neighbouring chunks, so that every run of so many words is inside one.

Block-max WAND, for all passages of a batch at once: posting lists are cut into blocks of entries, with the greatest impact of each word
in each block. A block's words are sorted by it; the pivot is where the sum of the least ones would pass a share of the threshold. Words before
the pivot can't lift an entry over the threshold by themselves, so their postings aren't opened. Lists from the pivot on are opened block by
block, and add up to a bound for each passage and block; where the bound with all words before the pivot reaches the threshold, the
block's entries are scored exactly. Entries at or over the threshold are verified on the passage's word n-grams: the item's, or its question's or answer's.

A shard is a bounded number of entries, and a pass over the documents takes a bounded number of items along, 8,192 by default.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, materialize, mix, sliced, utf8
from .bm25 import Blocks, expand, idf
from .words import BASE, SHINGLE, Words, words

_SENTENCE = re.compile(r"[.!?\n]+\s*(?=\S)")
#: The least length of a chunk; passages looked at together.
CHUNK, TOGETHER = 64, 4096


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    if len(hashes) < size or not size:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - size + 1] * np.uint64(BASE)
    for k in range(1, size):
        out = mix(out + hashes[k : len(hashes) - size + 1 + k]) * np.uint64(BASE)
    return out


def split(text: str) -> tuple[str, str]:
    """Question and answer: all sentences but the last, and the last; a single sentence is both."""
    cuts = [m.end() for m in _SENTENCE.finditer(text)]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, text)


def chunk_of(n: int) -> int:
    """The length of the chunks in which entries of n words are looked for."""
    return max(CHUNK, 1 << max(n - 1, 0).bit_length())


class Item:
    """words: hashes of the whole, the question and the answer; sets: their n-grams, of as many words as they have if they have less."""

    def __init__(self, item_id: int | None, text: str, size: int) -> None:
        self.item_id, self.words = item_id, [_hashes(x.lower()) for x in (text, *split(text))]
        self.sets = [(min(size, len(w)), np.unique(grams(w, min(size, len(w))))) for w in self.words]

    def overlaps(self, passage: np.ndarray) -> list[float]:
        return [float(np.isin(g, grams(passage, k)).mean()) if len(g) else 0.0 for k, g in self.sets]

    def parts(self, least: int) -> list[int]:
        """0 for the whole, and 1 and 2 for a question and an answer that are shorter, of ``least`` words and more."""
        return [0, *(p for p in (1, 2) if least <= len(self.words[p]) < len(self.words[0]))]


def _hashes(text: str) -> np.ndarray:
    return words(*utf8(pa.array([text]))).hashes


class Shard:
    """Entries of one class (item, and which part of it), with their index."""

    def __init__(self, entries: list[tuple[Item, int]], block: int, threshold: float, weigh: Callable[[np.ndarray], np.ndarray], mean: float) -> None:
        self.entries, self.threshold = entries, threshold
        self.chunk = chunk_of(len(entries[0][0].words[entries[0][1]]))
        self.index = Blocks([x.words[p] for x, p in entries], block, threshold, weigh, mean)
        wholes = Blocks([x.words[0] for x, _ in entries], 1, threshold, weigh, mean)
        #: For each entry, its item's words and what they add to the item's score.
        self.wholes = [(wholes.terms[wholes.term[a:b]], wholes.impact[a:b]) for a, b in zip(wholes.cut[:-1], wholes.cut[1:])]

    def search(self, w: Words, overlap: float, part_overlap: float) -> Iterator[tuple[int, Item, list[float]]]:
        """Document (its row), item, the item's score and overlaps, for each passage that gives it away."""
        index, terms = self.index, max(len(self.index.terms), 1)
        count = np.diff(w.first)
        chunks = -(-count // self.chunk)
        first = np.append(0, np.cumsum(chunks))
        where, term = index.find(w.hashes)
        if not len(where):
            return
        doc = w.doc[where]
        own = np.unique((first[doc] + (where - w.first[doc]) // self.chunk) * terms + term)  # words of chunks
        chunk = own // terms
        of = np.repeat(np.arange(len(count)), chunks)
        after = np.append(of[1:] == of[:-1], False)  # another chunk of the document follows
        before = np.append(False, after[:-1])
        # A chunk's words are in the passage that begins with it, unless that is only the end of the one before, and in the one before.
        pairs = np.unique(np.concatenate([own[after[chunk] | ~before[chunk]], own[before[chunk]] - terms]))
        passage, term = pairs // terms, pairs % terms
        cuts = np.searchsorted(passage, np.arange(0, int(first[-1]) + TOGETHER, TOGETHER))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            at, block = index.candidates(passage[a:b] - k * TOGETHER, term[a:b], TOGETHER)
            for c, e, _ in zip(*index.scored(pairs, at + k * TOGETHER, block)):
                d = int(of[c])
                start = w.first[d] + (c - first[d]) * self.chunk
                text = w.hashes[start : min(start + 2 * self.chunk, w.first[d + 1])]
                item, p = self.entries[e]
                shares = item.overlaps(text)
                if shares[p] >= (part_overlap if p else overlap):
                    hashes, impact = self.wholes[e]
                    yield d, item, [float(impact[np.isin(hashes, text)].sum()), *shares]


_FOUND = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def _searched(shards: list[Shard], overlap: float, part_overlap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            w = words(*utf8(batch.column("text")))
            best: dict[tuple[int, int], tuple[Item, list[float]]] = {}
            for s in shards:
                for d, item, values in s.search(w, overlap, part_overlap):
                    before = best.get((d, id(item)), (item, values))[1]
                    best[d, id(item)] = item, list(map(max, before, values))
            if best:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([d for d, _ in best])), pa.array([x.item_id for x, _ in best.values()], pa.int64()), *map(pa.array, zip(*(v for _, v in best.values())))], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

    return run


def _cleaned(shards: list[Shard], overlap: float, part_overlap: float, lower: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, lower):
            w = words(*utf8(batch.column(lower)))
            stay = np.ones(batch.num_rows, bool)
            for s in shards:
                stay[[d for d, _, _ in s.search(w, overlap, part_overlap)]] = False
            yield batch.filter(pa.array(stay))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word, how many items have it; and a row of zero for the number of words of all items."""
    for batch in sliced(batches, "text"):
        w = words(*utf8(batch.column("text")))
        pair = np.lexsort((w.doc, w.hashes))
        h, d = w.hashes[pair], w.doc[pair]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        terms, df = np.unique(h[fresh], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64)), pa.array(np.zeros(len(terms), np.int64)), pa.array(np.zeros(len(terms), np.int64))], names=["term", "df", "items", "words"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([int((np.diff(w.first) > 0).sum())]), pa.array([len(w.hashes)])], names=["term", "df", "items", "words"])


def _taken(items: Iterator[Item], most: int, most_words: int) -> list[Item]:
    """The next items: so many, or fewer with so many words, and one item more at most."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x.words[0])
        if len(held) >= most or size >= most_words:
            break
    return held


def _grouped(entries: list[tuple[Item, int]], most: int) -> Iterator[list[tuple[Item, int]]]:
    """Entries by class, so many together."""
    kind = lambda e: chunk_of(len(e[0].words[e[1]]))
    for _, own in itertools.groupby(sorted(entries, key=kind), kind):
        while some := list(itertools.islice(own, most)):
            yield some


def _passes(benchmark: DataFrame, threshold: float, size: int, block: int, shard: int, shard_words: int, shards: int, part_words: int) -> Iterator[list[Shard]]:
    """The shards of each pass over the documents; an item's entries are in one pass. Items come to the driver a pass at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.select(F.lower("text").alias("text")).mapInArrow(_counted, "term long, df long, items long, words long")
    counts = materialize(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("items").alias("items"), F.sum("words").alias("words")), "item-counts")
    total = counts.where("term is null").first()
    if total is None or not total["items"]:
        return
    items = (x for x in (Item(r["item_id"], r["text"], size) for r in rows.orderBy("item_id", "text").toLocalIterator()) if len(x.words[0]))
    while held := _taken(items, shard * shards, shard_words * shards):
        terms = np.unique(np.concatenate([x.words[0] for x in held]))
        asked = spark.createDataFrame(pa.table({"term": terms.view(np.int64)}))
        got = counts.join(asked, "term").select("term", "df").toPandas()  # a row a word of the pass
        order = np.argsort(got["term"].to_numpy(np.int64).view(np.uint64))
        weight = idf(got["df"].to_numpy(float)[order], total["items"])
        entries = [(x, p) for x in held for p in x.parts(part_words) if len(x.words[p])]
        yield [Shard(own, block, threshold, lambda t: weight[np.searchsorted(terms, t)], total["words"] / total["items"]) for own in _grouped(entries, 3 * shard)]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.3, size: int = SHINGLE, block: int = 4, shard: int = 512, shard_words: int = 200_000, shards: int = 16, part_words: int = 8, part_overlap: float = 0.5) -> DataFrame:
    """One row for each document and item it gives away: doc_id, item_id, score (BM25 by the best passage, as a share of the
    item's own), overlap, question_overlap, answer_overlap (shares of n-grams of ``size`` words).

    An item is given away by a passage that reaches ``threshold`` of its score and ``overlap`` of its n-grams, or, of its question or
    answer if that has ``part_words`` words and more, ``threshold`` of the part's own score and ``part_overlap`` of its n-grams. A single
    sentence is both question and answer. Counts that weigh words are those of all items, whatever the shards.

    docs: doc_id, text; benchmark: item_id, text. A null text is an empty one, and neither gives away nor can be. A null id is
    returned as it is; rows of equal doc_id are searched each by itself, and give equal rows if their texts are equal. An item
    that repeats is found as often. An empty table gives no rows. Items with fewer words than ``size`` are compared whole. Other columns are left out.
    """
    own = documents(docs).select("doc_id", F.lower("text").alias("text"))
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for n, group in enumerate(_passes(benchmark, threshold, size, block, shard, shard_words, shards, part_words)):
        more = own.mapInArrow(_searched(group, overlap, part_overlap), _FOUND)
        found = found.unionByName(more) if n else more
    return found


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.3, size: int = SHINGLE, block: int = 4, shard: int = 512, shard_words: int = 200_000, shards: int = 16, part_words: int = 8, part_overlap: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text, any others) that give no item away, by the rules of ``leaks``: each row is judged by its own text, so rows that
    share an id, or have none, neither go nor stay with one another. All columns stay."""
    lower = "lower"
    while lower in docs.columns:
        lower += "_"
    out = docs.withColumn(lower, F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    for group in _passes(benchmark, threshold, size, block, shard, shard_words, shards, part_words):
        out = out.mapInArrow(_cleaned(group, overlap, part_overlap, lower), T.StructType(out.schema.fields))
    return out.drop(lower)
