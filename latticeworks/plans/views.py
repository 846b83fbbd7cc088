"""Lattice views of the test tables, by whole-number formulas that read the same in any SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENT = 256_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points: id, x_mm, y_mm, kind, weight, nation."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % EXTENT).alias("x_mm"), (F.col("c_custkey") * 104729 % EXTENT).alias("y_mm"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("weight"), F.col("c_nationkey").alias("nation"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points: id, x_mm, y_mm."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 48611 % EXTENT).alias("x_mm"), (F.col("s_suppkey") * 15485863 % EXTENT).alias("y_mm"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as closed boxes: name, x0, y0, x1, y1."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (n * 9000 % 200_000).alias("x0"), (n * 17_000 % 200_000).alias("y0"), (n * 9000 % 200_000 + 40_000).alias("x1"), (n * 17_000 % 200_000 + 30_000).alias("y1"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three lines and more as paths: path, seq, x_mm, y_mm."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("seq"), "l_partkey", "l_suppkey").groupBy("path", "seq").agg((F.min("l_partkey") * 7919 % EXTENT).alias("x_mm"), (F.min("l_suppkey") * 104729 % EXTENT).alias("y_mm"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 40 columns and as many rows as all parts fill, part 0 being in row -1: i, j, value (whole numbers, as doubles)."""
    k = F.col("p_partkey") - 1
    return table(spark, sf_dir, "part").select(F.pmod(k, F.lit(40)).alias("i"), F.floor(k / 40).alias("j"), (F.col("p_partkey") * 7919 % 997).cast("double").alias("value"))


#: The same views in SQL.
SQL = {
    "points": "SELECT c_custkey AS id, c_custkey * 7919 % 256000 AS x_mm, c_custkey * 104729 % 256000 AS y_mm, c_mktsegment AS kind, c_acctbal AS weight, c_nationkey AS nation FROM customer",
    "sites": "SELECT s_suppkey AS id, s_suppkey * 48611 % 256000 AS x_mm, s_suppkey * 15485863 % 256000 AS y_mm FROM supplier",
    "boxes": "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) * 9000 % 200000 AS x0, CAST(n_nationkey AS BIGINT) * 17000 % 200000 AS y0, CAST(n_nationkey AS BIGINT) * 9000 % 200000 + 40000 AS x1, CAST(n_nationkey AS BIGINT) * 17000 % 200000 + 30000 AS y1 FROM nation",
    "vertices": "SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS seq, min(l_partkey) * 7919 % 256000 AS x_mm, min(l_suppkey) * 104729 % 256000 AS y_mm FROM lineitem GROUP BY 1, 2",
    "field": "SELECT (p_partkey + 39) % 40 AS i, (p_partkey + 39) // 40 - 1 AS j, CAST(p_partkey * 7919 % 997 AS DOUBLE) AS value FROM part",
}


def sql(body: str, *used: str) -> str:
    """``body`` after the views it uses."""
    views = ", ".join(f"{v} AS ({SQL[v]})" for v in used)
    return f"WITH {views}{',' if body.lstrip().upper().startswith('WITH ') else ''} {body.lstrip()[5:] if body.lstrip().upper().startswith('WITH ') else body}"
