"""Shared storage: where plans are cut, and results are kept, so that lost executors lose nothing of them."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, it is a new temporary one if all of Spark is in one
    process, as in tests, and else an error: each machine would have a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("storage.shared: set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="latticeworks-")
        shared_dir.own = base
    return base.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/latticeworks-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all that this application's operators keep in shared storage; results that aren't written elsewhere go with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(df: DataFrame, bytes_a_task: int = 64 << 20) -> int:
    """Tasks for a shuffle of ``df``: the session's shuffle partitions, or more where the files it reads, by Spark's own estimate, would
    make them larger than ``bytes_a_task``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // bytes_a_task)) if size < 1 << 60 else least  # beyond, Spark doesn't know


def spread(df: DataFrame, bytes_a_task: int = 1 << 20) -> DataFrame:
    """The same rows dealt to as many tasks as work on each row needs, rather than to as few as its bytes would fit: by the size of the files that
    ``df`` reads, as what Spark expects of joins is often far too much."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    size = 0
    while leaves.hasNext():
        own = int(str(leaves.next().stats().sizeInBytes()))
        size += own if own < 1 << 60 else 0  # beyond, Spark doesn't know
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_a_task)))


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What runs inside hands rows to Python in batches of about ``size``, which bounds what both sides hold at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: cuts lineage, and a lost executor loses nothing of it."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a materialized table that no later step reads."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if shared_dir(spark).split(":", 1)[-1].lstrip("/") in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, which it does when the driver collects its
    garbage: once for the plans, and once more for what they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
