"""Graphs as DataFrames of edges: fixpoints whose rounds are written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_table, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or, else, smaller) neighbours are tied to its least neighbour; nodes of high degree are sums and splittable joins."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        return tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of the edges a, b but the roots themselves.

    Alternates large and small stars (Kiveris et al., 2014) until no edge changes. Self-loops and null ends are no edges.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = state
        after = materialize(_star(_star(now, True).distinct(), False).where("a != b").distinct(), "edges")
        drop_table(now)
        now = after


class _Gathered:
    """Rows that come a table a round, read as one. After every eight tables all are written as one, so that plans don't grow with the rounds."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def add(self, table: DataFrame) -> None:
        self.tables.append(table)
        if len(self.tables) > 8:
            whole = materialize(self.rows(), "gathered")
            for t in self.tables:
                drop_table(t)
            self.tables = [whole]

    def rows(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out


def levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, level: the least number of edges a -> b from any of the starts (node), by breadth-first rounds."""
    known, n = _Gathered(), 0
    known.add(materialize(starts.select("node").distinct().withColumn("level", F.lit(0).cast("long")), "levels"))
    while True:
        n += 1
        front = known.rows().where(F.col("level") == n - 1)
        reached = front.join(edges.select(F.col("a").alias("node"), F.col("b").alias("to")), "node").select(F.col("to").alias("node")).distinct()
        fresh = materialize(reached.join(known.rows(), "node", "left_anti").withColumn("level", F.lit(n).cast("long")), "levels")
        if fresh.isEmpty():
            return known.rows()
        known.add(fresh)


def causes(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """node, cause, chain: for each changed node (node) and each node it reaches over edges a -> b, itself among them, a shortest chain from one to the
    other, of those the least. Breadth-first rounds, one an edge of the longest chain; a round's rows come from the round's before alone."""
    known, n = _Gathered(), 0
    known.add(materialize(changed.select("node").distinct().select("node", F.col("node").alias("cause"), F.array("node").alias("chain")), "causes"))
    onward = edges.where("a is not null and b is not null").select(F.col("a").alias("node"), F.col("b").alias("to"))
    while True:
        n += 1
        front = known.rows().where(F.size("chain") == n)
        reached = front.join(onward, "node").groupBy(F.col("to").alias("node"), "cause").agg(F.min("chain").alias("chain"))
        fresh = reached.join(known.rows().select("node", "cause"), ["node", "cause"], "left_anti").select("node", "cause", F.concat("chain", F.array("node")).alias("chain"))
        fresh = materialize(fresh, "causes")
        if fresh.isEmpty():
            return known.rows()
        known.add(fresh)


def relax(values: DataFrame, edges: DataFrame, through) -> DataFrame:
    """The least value each node can have: its own, or ``through(value of a, cost)`` over an edge a -> b. values: node, value;
    edges: a, b, cost. Rounds go on until no value falls, so ``through`` must not lower a value."""
    now = materialize(values.select("node", "value"), "values")
    while True:
        offer = now.join(edges.select(F.col("a").alias("node"), "b", "cost"), "node").groupBy(F.col("b").alias("node")).agg(F.min(through(F.col("value"), F.col("cost"))).alias("offer"))
        after = materialize(now.join(offer, "node", "left").select("node", F.least("value", "offer").alias("value"), (F.col("offer") < F.col("value")).alias("fell")), "values")
        fell = not after.where("fell").isEmpty()
        drop_table(now)
        now = after.select("node", "value")
        if not fell:
            return now


def depths(edges: DataFrame) -> DataFrame:
    """node, level: the most edges on a way to each node of an acyclic graph; a cycle is an error. Each round raises what its edges still can."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = materialize(nodes.withColumn("level", F.lit(0).cast("long")), "depths")
    most = now.count()
    while True:
        offer = now.join(edges.select(F.col("a").alias("node"), "b"), "node").groupBy(F.col("b").alias("node")).agg((F.max("level") + 1).alias("offer"))
        after = materialize(now.join(offer, "node", "left").select("node", F.greatest("level", F.coalesce("offer", F.lit(0))).alias("level"), (F.col("offer") > F.col("level")).alias("rose")), "depths")
        state = after.agg(F.bool_or("rose").alias("rose"), F.max("level").alias("top")).first()
        drop_table(now)
        now = after.select("node", "level")
        if not state["rose"]:
            return now
        if state["top"] > most:
            raise ValueError("graph.cycle: the edges have no order")


def independent(rows: DataFrame, ties: DataFrame) -> DataFrame:
    """Ids that are kept if a row goes where one ahead of it (ties: id, ahead) is kept. In each round, rows with nothing undecided ahead are
    kept or go; the result is that of the sequence."""
    left, ahead, kept = materialize(rows.select("id"), "left"), materialize(ties.distinct(), "ties"), _Gathered()
    while not left.isEmpty():
        free = materialize(left.join(ahead.select("id").distinct(), "id", "left_anti"), "free")
        gone = ahead.join(free.select(F.col("id").alias("ahead")), "ahead", "left_semi").select("id").distinct()
        after = materialize(left.join(free, "id", "left_anti").join(gone, "id", "left_anti"), "left")
        still = ahead.join(after, "id", "left_semi").join(after.select(F.col("id").alias("ahead")), "ahead", "left_semi")
        still = materialize(still.select("id", "ahead"), "ties")
        kept.add(free)
        drop_table(left)
        drop_table(ahead)
        left, ahead = after, still
    return kept.rows() if kept.tables else rows.select("id")
