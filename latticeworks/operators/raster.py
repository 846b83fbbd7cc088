"""Rasters as rows (i, j, value): posts, neighbours, samples, frames and flows.

Neighbour values come from windows over rows and columns of the grid, which are whole lines of posts and no more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import drop_table, materialize
from .shapes import mask_rings


def posts(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """All posts, from the south, west to east."""
    return spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))


def chunks(field: DataFrame, side: int) -> DataFrame:
    """Posts by square chunk; posts on an edge belong to the chunks on both sides."""
    spans = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / side), F.floor(F.greatest(F.col(c) - 1, F.lit(0)) / side)))
    return field.withColumn("cx", F.explode(spans("i"))).withColumn("cy", F.explode(spans("j")))


def _steps(value: str, along: str, across: str, spacing: float) -> Column:
    """Central difference; one-sided at an edge; null without a neighbour."""
    w = Window.partitionBy(across).orderBy(along)
    a, b, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * spacing)).when(b.isNotNull(), (b - v) / spacing).when(a.isNotNull(), (v - a) / spacing)


def slope(field: DataFrame, spacing: float) -> DataFrame:
    """Degrees, 0 to 90, at each post."""
    g = field.withColumns({"gx": _steps("value", "i", "j", spacing), "gy": _steps("value", "j", "i", spacing)})
    return g.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))).drop("gx", "gy")


def bilinear(points: DataFrame, field: DataFrame, spacing: int) -> DataFrame:
    """Points (id, x_mm, y_mm) with the field's value between their four posts. Each post goes to one join key, and a point to four."""
    base = points.withColumns({"i0": F.floor(F.col("x_mm") / spacing), "j0": F.floor(F.col("y_mm") / spacing)}).withColumns({"fx": F.col("x_mm") / F.lit(float(spacing)) - F.col("i0"), "fy": F.col("y_mm") / F.lit(float(spacing)) - F.col("j0")})
    corner = base.withColumn("a", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("b", F.explode(F.array(F.lit(0), F.lit(1))))
    weight = F.when(F.col("a") == 1, F.col("fx")).otherwise(1.0 - F.col("fx")) * F.when(F.col("b") == 1, F.col("fy")).otherwise(1.0 - F.col("fy"))
    met = corner.withColumns({"i": F.col("i0") + F.col("a"), "j": F.col("j0") + F.col("b"), "weight": weight}).where("weight > 0").join(field, ["i", "j"])
    return met.groupBy("id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.sum("weight").alias("cover")).where("cover > 1 - 1e-9").drop("cover")


def frame(field: DataFrame, reach: int, how: str = "mean") -> DataFrame:
    """A mean, least or greatest value over a square of posts, along rows and then columns; squares shrink at edges."""
    pick = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    row = Window.partitionBy("j").orderBy("i").rangeBetween(-reach, reach)
    column = Window.partitionBy("i").orderBy("j").rangeBetween(-reach, reach)
    return field.withColumn("half", pick("value").over(row)).withColumn("framed", pick("half").over(column)).drop("half")


def neighbours(field: DataFrame, around: int = 8) -> DataFrame:
    """Edges between posts of a field and their 4 or 8 neighbours: a, b (structs of i, j), va, vb, diagonal."""
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x or y) and (around == 8 or not (x and y))]
    to = F.explode(F.array(*(F.struct((F.col("i") + x).alias("i"), (F.col("j") + y).alias("j")) for x, y in steps)))
    own = field.select(F.struct("i", "j").alias("a"), F.col("value").alias("va"), to.alias("b"))
    met = own.join(field.select(F.struct("i", "j").alias("b"), F.col("value").alias("vb")), "b")
    return met.withColumn("diagonal", (F.col("a.i") != F.col("b.i")) & (F.col("a.j") != F.col("b.j")))


def with_rim(field: DataFrame) -> DataFrame:
    """``field`` with rim: whether a post lacks one of 8 neighbours."""
    inner = neighbours(field).groupBy("a").agg(F.count("*").alias("n")).where("n = 8").select(F.col("a.i").alias("i"), F.col("a.j").alias("j"), F.lit(False).alias("inner"))
    return field.join(inner, ["i", "j"], "left").withColumn("rim", F.col("inner").isNull()).drop("inner")


def settle(field: DataFrame, through: Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray], side: int = 256) -> DataFrame:
    """i, j, now: the least value each post can have, its own or one that comes from a neighbour by ``through`` (the neighbour's value, its height,
    the post's height, the step's length), which must not be under the neighbour's. field: i, j, value (height), now (inf: none yet).

    Tiles of ``side`` posts are settled whole, in arrays, with their neighbours' outer posts as given; only tiles beside posts that fell are
    settled again, so rounds follow the number of tiles that a way crosses, not its posts.
    """
    spans = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / side), F.floor((F.col(c) - 1) / side), F.floor((F.col(c) + 1) / side)))
    around = lambda posts: posts.withColumn("ti", F.explode(spans("i"))).withColumn("tj", F.explode(spans("j")))
    steps = [(x, y, float(np.hypot(x, y))) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        a, b = i - i.min() + 1, j - j.min() + 1
        shape = (int(a.max()) + 2, int(b.max()) + 2)
        z, now, own = np.full(shape, np.inf), np.full(shape, np.inf), np.zeros(shape, bool)
        z[a, b], now[a, b] = rows["value"], rows["now"]
        own[a, b] = (i // side == rows["ti"]) & (j // side == rows["tj"])
        there = np.isfinite(z)
        here, before = (slice(1, -1), slice(1, -1)), now.copy()
        while True:
            last = now.copy()
            for x, y, length in steps:
                beside = (slice(1 + x, shape[0] - 1 + x), slice(1 + y, shape[1] - 1 + y))
                can = own[here] & there[beside] & (now[beside] < np.inf)
                offer = np.where(can, through(np.where(can, now[beside], 0.0), np.where(can, z[beside], 0.0), np.where(can, z[here], 0.0), length), np.inf)
                np.minimum(now[here], offer, out=now[here])
            if (now == last).all():
                break
        keep = own[a, b]
        return pd.DataFrame({"ti": rows["ti"], "tj": rows["tj"], "i": i, "j": j, "value": rows["value"], "now": now[a, b], "fell": now[a, b] < before[a, b]})[keep]

    schema = "ti long, tj long, i long, j long, value double, now double, fell boolean"
    state = materialize(field.select(F.floor(F.col("i") / side).alias("ti"), F.floor(F.col("j") / side).alias("tj"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"), F.col("now").cast("double").alias("now"), F.lit(False).alias("fell")), "tiles")
    active = materialize(around(state.where(F.col("now") < float("inf")).select("i", "j")).select("ti", "tj").distinct(), "active")
    while not active.isEmpty():
        outer = (F.pmod("i", F.lit(side)).isin(0, side - 1)) | (F.pmod("j", F.lit(side)).isin(0, side - 1))
        halo = around(state.where(outer).select("i", "j", "value", "now")).where((F.col("ti") != F.floor(F.col("i") / side)) | (F.col("tj") != F.floor(F.col("j") / side)))
        given = state.select("ti", "tj", "i", "j", "value", "now").unionByName(halo).join(active, ["ti", "tj"], "left_semi")
        solved = given.groupBy("ti", "tj").applyInPandas(solve, schema)
        after = materialize(state.join(active, ["ti", "tj"], "left_anti").withColumn("fell", F.lit(False)).unionByName(solved), "tiles")
        fallen = after.where(outer & F.col("fell")).select(F.col("ti").alias("hi"), F.col("tj").alias("hj"), "i", "j")
        moved = materialize(around(fallen).where("ti != hi or tj != hj").select("ti", "tj").distinct(), "active")
        drop_table(state)
        drop_table(active)
        state, active = after, moved
    return state.select("i", "j", "now")


def fill(field: DataFrame, rim: Column, side: int = 256, epsilon: float = 0.0) -> DataFrame:
    """Each post raised to its spill: the least, over ways to a post of the rim, of the highest post on the way. As a fixpoint of
    minima and maxima, which the order of rounds doesn't change. ``epsilon``: how much higher than the next post on its way each is at least, so that
    what is filled drains."""
    start = field.select("i", "j", "value", F.when(rim, F.col("value").cast("double")).otherwise(F.lit(float("inf"))).alias("now"))
    return settle(start, lambda now, beside, here, length: np.maximum(now + epsilon, here), side).withColumnRenamed("now", "filled")


def course(field: DataFrame, start: Column, target: Column, side: int = 256) -> DataFrame:
    """i, j, cost of the posts on the cheapest ways from a start to the posts of ``target``: each post points to the neighbour that its cost comes
    through (ties by j, i), and pointers are followed by jumps of halving length, so rounds grow with the logarithm of the longest way."""
    cost = materialize(least_cost(field, start, side).join(field.select("i", "j", "value", target.alias("target")), ["i", "j"]).where(F.col("cost") < float("inf")), "cost")
    legs = neighbours(cost.withColumn("value", F.struct("value", "cost")))
    length = F.when(F.col("diagonal"), F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0))
    through = legs.where("vb.cost < va.cost").groupBy("a").agg(F.min(F.struct((F.col("vb.cost") + (F.col("va.value") + F.col("vb.value")) / 2 * length).alias("c"), F.col("b.j").alias("j"), F.col("b.i").alias("i"))).alias("t"))
    jumps = [materialize(through.select("a", F.struct(F.col("t.i").alias("i"), F.col("t.j").alias("j")).alias("b")), "jump")]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(materialize(last.join(last.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "jump"))
    on = cost.where("target").select(F.struct("i", "j").alias("a"))
    for jump in reversed(jumps[:-1]):
        on = materialize(on.unionByName(on.join(jump, "a").select(F.col("b").alias("a"))).distinct(), "on")
    for jump in jumps:
        drop_table(jump)
    return on.select("a.i", "a.j").join(cost.select("i", "j", "cost"), ["i", "j"])


def flow_shares(field: DataFrame) -> DataFrame:
    """i, j, slope, and up to two receivers with their shares (i1, j1, share1, i2, j2, share2): the steepest descent over the eight triangles around a
    post (Tarboton, 1997). A post that no triangle descends from has none. Equal slopes go by the triangle's number, from the east counter-clockwise."""
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    near = neighbours(field).select("a", "va", "vb", (F.col("b.i") - F.col("a.i")).alias("di"), (F.col("b.j") - F.col("a.j")).alias("dj"))
    at = near.groupBy("a", "va").agg(*(F.max(F.when((F.col("di") == x) & (F.col("dj") == y), F.col("vb"))).alias(f"v{k}") for k, (x, y) in enumerate(ring)))
    facets = []
    for n in range(8):
        k, m = (n, (n + 1) % 8) if n % 2 == 0 else ((n + 1) % 8, n)  # the straight and the diagonal corner
        s1, s2 = F.col("va") - F.col(f"v{k}"), F.col(f"v{k}") - F.col(f"v{m}")
        r = F.when(s2 <= 0, F.lit(0.0)).when(s2 >= s1, F.lit(np.pi / 4)).otherwise(F.atan2(s2, s1))
        s = F.when(s2 <= 0, s1).when(s2 >= s1, (F.col("va") - F.col(f"v{m}")) / F.sqrt(F.lit(2.0))).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        facets.append(F.struct((-s).alias("down"), F.lit(n).alias("n"), (r / (np.pi / 4)).alias("turn"), F.lit(ring[k][0]).alias("ki"), F.lit(ring[k][1]).alias("kj"), F.lit(ring[m][0]).alias("mi"), F.lit(ring[m][1]).alias("mj")))
    best = at.select("a", F.array_min(F.filter(F.array(*facets), lambda f: f["down"] < 0)).alias("f")).where("f is not null")
    share = lambda c, one: F.when(c > 0, one)
    first, second = 1 - F.col("f.turn"), F.col("f.turn")
    return best.select("a.i", "a.j", (-F.col("f.down")).alias("slope"), share(first, F.col("a.i") + F.col("f.ki")).alias("i1"), share(first, F.col("a.j") + F.col("f.kj")).alias("j1"), share(first, first).alias("share1"), share(second, F.col("a.i") + F.col("f.mi")).alias("i2"), share(second, F.col("a.j") + F.col("f.mj")).alias("j2"), share(second, second).alias("share2"))


def least_cost(field: DataFrame, start: Column, side: int = 256) -> DataFrame:
    """The least cost of a way over 8 neighbours from a start to each post. A step costs the mean of its posts, times sqrt(2) if diagonal."""
    begin = field.select("i", "j", "value", F.when(start, F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("now"))
    return settle(begin, lambda now, beside, here, length: now + (beside + here) / 2 * length, side).withColumnRenamed("now", "cost")


def receivers(field: DataFrame) -> DataFrame:
    """The steepest lower of 8 neighbours of each post, ties by j, i; pits have none."""
    drop = (F.col("va") - F.col("vb")) / F.when(F.col("diagonal"), F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0))
    down = neighbours(field).where("vb < va").groupBy("a").agg(F.min(F.struct((-drop).alias("d"), F.col("b.j").alias("j"), F.col("b.i").alias("i"))).alias("r"))
    return down.select(F.col("a"), F.struct(F.col("r.i").alias("i"), F.col("r.j").alias("j")).alias("b"))


def accumulate(field: DataFrame, weight: Column | None = None) -> DataFrame:
    """Posts upstream of each post, itself included, or the sum of their weights (whole numbers): by jumps of doubling length along receivers, so rounds grow with the logarithm of
    the longest way. After round n, each post has a tie to every post within 2**n steps downstream."""
    jump = materialize(receivers(field), "jump")
    count = materialize(field.select(F.struct("i", "j").alias("node"), (F.lit(1) if weight is None else weight).cast("long").alias("n")), "count")
    while not jump.isEmpty():
        sent = jump.join(count.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("more"))
        after = materialize(count.join(sent, "node", "left").select("node", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "count")
        further = materialize(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "jump")
        drop_table(jump)
        drop_table(count)
        jump, count = further, after
    return count.select("node.i", "node.j", "n")


def zonal(field: DataFrame, zones: DataFrame) -> DataFrame:
    """mean, least and greatest value of a field over zones (name, i, j)."""
    return zones.join(field, ["i", "j"]).groupBy("name").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.count("*").alias("posts"))


def changed_region(old: DataFrame, new: DataFrame, side: int) -> DataFrame:
    """Per chunk: bounding box of posts that differ, their number, and the greatest difference."""
    both = old.withColumnRenamed("value", "was").join(new, ["i", "j"]).where(~F.col("was").eqNullSafe(F.col("value")))
    cell = both.withColumns({"cx": F.floor(F.col("i") / side), "cy": F.floor(F.col("j") / side)})
    return cell.groupBy("cx", "cy").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), F.max("i").alias("i1"), F.max("j").alias("j1"), F.count("*").alias("posts"), F.max(F.abs(F.col("value") - F.col("was"))).alias("most"))


def basins(field: DataFrame) -> DataFrame:
    """i, j, and the pit (pi, pj) at the end of each post's receivers. Each round doubles the jumps, so rounds grow with the logarithm of
    the longest way."""
    down = receivers(field)
    here = field.select(F.struct("i", "j").alias("a"))
    now = materialize(here.join(down, "a", "left").select("a", F.coalesce("b", "a").alias("b")), "basins")
    while True:
        after = materialize(now.join(now.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"), (F.col("b") != F.col("c")).alias("moved")), "basins")
        moved = not after.where("moved").isEmpty()
        drop_table(now)
        now = after.select("a", "b")
        if not moved:
            return now.select("a.i", "a.j", F.col("b.i").alias("pi"), F.col("b.j").alias("pj"))


def outlines(field: DataFrame, by: str) -> DataFrame:
    """Rings around where a field is above 0, for each group of posts: by, ring, n, x, y (in posts)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rings = mask_rings(dict(zip(zip(rows["i"].tolist(), rows["j"].tolist()), rows["value"].tolist())))
        rings = sorted(r[r.index(min(r)) :] + r[: r.index(min(r))] for r in rings)  # each from its least vertex on
        out = [(rows[by].iloc[0], k, n, x, y) for k, r in enumerate(rings) for n, (x, y) in enumerate(r)]
        return pd.DataFrame(out, columns=[by, "ring", "n", "x", "y"])

    return field.select(by, "i", "j", "value").groupBy(by).applyInPandas(one, f"{by} long, ring long, n long, x double, y double")
