"""From raw documents to packed sequences: quality, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; run() writes each stage's rows as Parquet to the shared
folder and reads them again as the next one's docs.

Nulls and repeats: a null text is an empty one, in every stage. Rows are judged one by one, not by their ids, so rows that share a doc_id, or have
none, don't go or stay with one another; of rows that are equal in all columns the near duplicates' stage keeps one, like of any class. Empty tables
give no rows; columns other than those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.llm import quality
from latticeworks.llm._common import materialize, table
from latticeworks.llm.decontaminate import clean
from latticeworks.llm.lines import drop_boilerplate
from latticeworks.llm.near import first_of_each
from latticeworks.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more; it learns from the documents of this stage."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, trees).where("score >= 0.3").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their sources' boilerplate lines; a document without a character left goes."""
    clean = drop_boilerplate(docs, host="source")
    changed = clean.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.where((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != "")).select(COLUMNS)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id, and of rows that are equal one."""
    return first_of_each(docs.select(COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, in sequences of 2048."""
    return pack(docs, "byte_bpe_50k.json", end_id=1, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_first),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Tokenization, boosted trees and hashed bands have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
