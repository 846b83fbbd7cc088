"""Site-relative line de-duplication, in Spark expressions alone.

A line's frequency on a host is the share of the host's pages that hold it. Lines at or over a share are boilerplate there.
Pages are counted once a line (distinct lines of a page, as 64-bit hashes), partly on the map side, so a host or line that
holds a large share of all rows is a sum of a few rows a task. The boilerplate of a host is bounded: with L distinct lines a
page on average, no more than L / ratio lines can reach the ratio. It is written as one array a host, whose size Spark knows
before it chooses between a broadcast and a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _keys(text: Column) -> Column:
    """Hashes of the lines; 0 for blank ones."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.trim(x))))


def boilerplate(pages: DataFrame, host: str, text: str, percent: int, min_pages: int) -> DataFrame:
    """host, keys: the hashes of each host's boilerplate lines."""
    own = pages.select(F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = own.select("host", F.explode(F.array_distinct(_keys(F.col("text")))).alias("key")).where("key != 0")
    often = seen.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    total = own.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    kept = often.join(total, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") * 100 >= F.col("pages") * percent)
    return kept.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", percent: int = 8, min_pages: int = 5) -> DataFrame:
    """The rows of ``pages`` with lines taken out of ``text`` that at least ``percent`` % of their host's pages, and at least
    ``min_pages``, hold; and n_lines, n_dropped. Lines end at a line feed and are compared without spaces around them; blank lines stay.

    A null text is an empty one, of one blank line; null hosts are one host; repeated rows are pages of their own. An empty
    table gives no rows. Other columns stay, except that n_lines and n_dropped replace columns of these names.
    """
    mark = "__"
    while any(c.lower().startswith(mark) for c in pages.columns):  # names of our own
        mark += "_"
    of, keys, all_, kept = (mark + x for x in ("host", "keys", "lines", "kept"))
    bad = materialize(boilerplate(pages, host, text, percent, min_pages), "boilerplate").select(F.col("host").alias(of), F.col("keys").alias(keys))
    joined = pages.withColumn(text, F.coalesce(F.col(text), F.lit(""))).join(bad, F.col(host).eqNullSafe(F.col(of)), "left")
    lines = joined.withColumn(all_, F.split(F.col(text), "\n", -1)).withColumn(kept, F.when(F.col(keys).isNull(), F.col(all_)).otherwise(F.filter(all_, lambda x: ~F.array_contains(keys, F.xxhash64(F.trim(x))))))
    columns = [F.when(F.size(kept) == F.size(all_), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(f"`{c}`") for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return lines.select(*columns, F.size(all_).cast("long").alias("n_lines"), (F.size(all_) - F.size(kept)).cast("long").alias("n_dropped"))
