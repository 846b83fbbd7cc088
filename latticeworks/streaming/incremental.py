"""Incremental upkeep of a summary: only chunks that new rows touch are made anew.

A stream of edits (rows to add) comes as files. Each micro-batch names the chunks it touches; their rows are read again, their
summaries replaced, and those of all other chunks kept. A batch that is replayed gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def upkeep(spark: SparkSession, edits: DataFrame, rows_path: str, summary_path: str, chunk: list[str], summarize: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Start the stream. Rows go to ``rows_path`` by batch, summaries to ``summary_path`` by version; the last version is current."""

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{rows_path}/batch={number}")
        touched = batch.select(*chunk).distinct()
        rows = spark.read.parquet(rows_path).where(f"batch <= {number}").drop("batch")
        fresh = summarize(rows.join(touched, chunk, "left_semi"))
        before = current(spark, summary_path, number - 1)
        kept = before.join(touched, chunk, "left_anti") if before is not None else None
        out = fresh if kept is None else kept.select(fresh.columns).unionByName(fresh)
        out.write.mode("overwrite").parquet(f"{summary_path}/version={number}")

    return edits.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, summary_path: str, most: int | None = None) -> DataFrame | None:
    """The summary as of the last batch, or as of a batch."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(summary_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    versions = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    versions = [v for v in versions if most is None or v <= most]
    return spark.read.parquet(f"{summary_path}/version={max(versions)}") if versions else None
