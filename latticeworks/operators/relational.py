"""Relational operators over typed tables: lookups, overlays, ordered folds, shares, diffs and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(refs: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """References with their targets' columns."""
    return refs.join(targets, refs[ref] == targets[key])


def unknown(refs: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """References that no target answers."""
    return refs.join(targets.select(F.col(key).alias(ref)), ref, "left_anti")


def overlay(rows: DataFrame, defaults: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Rows whose own values win over their kind's defaults."""
    own = defaults.select(on, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = rows.join(own, on, "left")
    return joined.select(*(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def last_writer(rows: DataFrame, by: list[str], order: str, mask: str, value: str) -> DataFrame:
    """The last entry, in order, whose mask is above 0."""
    return rows.where(F.col(mask) > 0).groupBy(*by).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def mix_rows(rows: DataFrame, by: list[str], order: str, value: str, mask: str, base: float = 0.0) -> DataFrame:
    """v = (1 - m) * v + m * value over each group's rows, in order."""
    folded = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v"), F.col(mask).alias("m")))).alias("rows"))
    return folded.select(*by, F.aggregate("rows", F.lit(base), lambda v, r: (F.lit(1.0) - r["m"]) * v + r["m"] * r["v"]).alias("value"))


def paint_rows(rows: DataFrame, by: list[str], order: str, paint: str, mask: str) -> DataFrame:
    """Weights of materials after each row scales all others by 1 - m and adds m to its own: a row's own share is its mask times what
    later rows leave, so one product over later rows does for the fold."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    left = F.coalesce(F.product(F.lit(1.0) - F.col(mask)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return rows.withColumn("share", F.col(mask) * left).groupBy(*by, paint).agg(F.sum("share").alias("weight"))


def ordinals(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rank from 0 among rows that share a digest, by their anchor points."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def weighted_choice(choices: DataFrame, group: str, order: str, weight: str, target: Column) -> DataFrame:
    """The first entry of each group whose running weight exceeds the target."""
    w = Window.partitionBy(group).orderBy(order)
    run = choices.withColumn("running", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = run.withColumn("total", F.sum(weight).over(Window.partitionBy(group)))
    return total.where(F.col("running") > target).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def largest_remainder(rows: DataFrame, group: str, key: str, weight: str, units: int) -> DataFrame:
    """Whole shares of ``units`` in proportion to whole weights: floors, and a unit more for the largest remainders, ties by key."""
    total = F.sum(weight).over(Window.partitionBy(group))
    own = rows.withColumn("floor", F.expr(f"({weight} * {units}) div 1")).withColumn("total", total)
    own = own.withColumn("floor", F.expr(f"({weight} * {units}) div total")).withColumn("rest", F.expr(f"({weight} * {units}) % total"))
    spare = F.lit(units) - F.sum("floor").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("rest"), key))
    return own.withColumn("spare", spare).withColumn("share", F.col("floor") + (rank <= F.col("spare")).cast("long")).select(group, key, "share")


def fold(rows: DataFrame, by: list[str], order: list[Column], keep: int = 5) -> DataFrame:
    """A row for each group: how many, and its first ``keep`` occurrences. Ranks are cut in each partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep)
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return first.join(counted, by)


def moving_mean(rows: DataFrame, path: str, order: str, value: str, reach: int) -> DataFrame:
    """A centred mean of ``reach`` samples on either side, shrinking at the ends, twice."""
    w = Window.partitionBy(path).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("once", F.avg(value).over(w)).withColumn("smooth", F.avg("once").over(w)).drop("once")


def fixed_sum(rows: DataFrame, by: list[str], order: str, value: str, chunk: int = 1024) -> DataFrame:
    """A sum whose order doesn't depend on partitions: rows in order within chunks of ``chunk``, then the chunks in order."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    placed = rows.withColumn("chunk", F.floor(nth / chunk))
    add = lambda name: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(name, F.col(value).alias("v")))), lambda r: r["v"]), F.lit(0.0), lambda a, b: a + b)
    parts = placed.groupBy(*by, "chunk").agg(add(order).alias(value))
    return parts.groupBy(*by).agg(add("chunk").alias("total"))


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key that is added, removed or changed, with its values before and after."""
    a = old.select(key, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("was"))
    b = new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("is"))
    both = a.join(b, key, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(same, "untouched").otherwise("changed")
    return both.withColumn("status", status).drop("was", "is")


def apply_changes(rows: DataFrame, edits: DataFrame, key: str, column: str) -> DataFrame:
    """Rows after edits (key, op, value): ``set`` writes the column, ``unset`` empties it, ``remove`` drops the row, ``add`` makes one."""
    last = edits.groupBy(key).agg(F.max_by(F.struct("op", "value"), "seq").alias("e"))
    both = rows.join(last, key, "full_outer").where(F.coalesce(F.col("e.op") != "remove", F.lit(True)))
    value = F.when(F.col("e.op").isin("set", "add"), F.col("e.value")).when(F.col("e.op") == "unset", F.lit(None)).otherwise(F.col(column))
    return both.withColumn(column, value).drop("e")


def conflicts(writes: DataFrame, change: str, path: str) -> DataFrame:
    """Pairs of changes that write one path, or a path and one of its prefixes. Each path meets its prefixes as an equi-join; a change writes a path,
    or below a prefix, once, however many of its rows do."""
    once = writes.select(change, path).distinct()
    parts = F.split(path, "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    prefixes = once.where(F.col(path).isNotNull()).select(F.col(change).alias("other"), prefix.alias("prefix")).distinct()
    met = once.join(prefixes, (F.col(path) == F.col("prefix")) & (F.col(change) != F.col("other")))
    return met.select(F.least(change, "other").alias("one"), F.greatest(change, "other").alias("two"), F.col("prefix").alias("shared")).distinct()


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Removes one copy of each record."""
    return a.exceptAll(b)


def nearest_names(unknowns: DataFrame, name: str, known: DataFrame, candidate: str, most: int = 3, keep: int = 5) -> DataFrame:
    """Known names within an edit distance, the nearest ``keep`` of each unknown one. Two names within distance d share a run: pieces of
    both are joined, not all pairs: of d + 1 pieces of a name at least one stands unchanged in the other, at most d places off."""
    pieces = lambda c: F.expr(f"transform(sequence(0, {most}), k -> struct(k, substring({c}, cast(floor(length({c}) * k / {most + 1}) as int) + 1, cast(floor(length({c}) * (k + 1) / {most + 1}) - floor(length({c}) * k / {most + 1}) as int)) as piece, cast(floor(length({c}) * k / {most + 1}) as int) as at))")
    cut = known.select(F.col(candidate).alias("candidate"), F.explode(pieces(candidate)).alias("p")).select("candidate", F.col("p.piece").alias("piece"), F.col("p.at").alias("at")).withColumn("size", F.length("piece"))
    sizes = [r[0] for r in cut.select("size").distinct().collect()]  # lengths of pieces, a handful
    grams = unknowns.select(F.col(name).alias("name")).distinct()
    runs = grams.select("name", F.explode(F.array(*(F.lit(s) for s in sizes)) if sizes else F.array(F.lit(0))).alias("size")).where("size <= length(name)")
    runs = runs.select("name", "size", F.explode(F.expr("sequence(0, length(name) - size)")).alias("at_name")).withColumn("piece", F.expr("substring(name, at_name + 1, size)"))
    met = runs.join(cut, ["piece", "size"]).where(F.abs(F.col("at_name") - F.col("at")) <= most).select("name", "candidate").distinct()
    rated = met.withColumn("distance", F.levenshtein("name", "candidate")).where(F.col("distance") <= most)
    rank = F.row_number().over(Window.partitionBy("name").orderBy("distance", "candidate"))
    return rated.withColumn("nth", rank).where(F.col("nth") <= keep)
