"""What runs downhill over a raster: shares of several receivers, and folds from the heights down, tile by tile.

A post is worked out once all that flows to it is known. In a tile that goes level by level, in arrays; what crosses to other tiles is
handed over between rounds, so rounds follow the tiles that a course crosses, and only tiles that something new comes to are opened.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop_table, materialize
from .raster import flow_shares, neighbours, receivers

#: Columns of the posts at hand, what flows to them, and the least mark of the posts that it comes from (inf: none); gives what each keeps, what it sends on, and its own mark.
Fold = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def spread(field: DataFrame, exponent: float = 1.1, spacing: float = 1.0) -> DataFrame:
    """Ties i, j, bi, bj, share: all lower of 8 neighbours of a post, with shares as powers of the slopes to them (Freeman, 1991)."""
    length = F.when(F.col("diagonal"), F.sqrt(F.lit(2.0))).otherwise(F.lit(1.0)) * spacing
    down = neighbours(field).where("vb < va").select("a", "b", F.pow((F.col("va") - F.col("vb")) / length, F.lit(exponent)).alias("w"))
    total = down.groupBy("a").agg(F.sum("w").alias("total"))
    return down.join(total, "a").select("a.i", "a.j", F.col("b.i").alias("bi"), F.col("b.j").alias("bj"), (F.col("w") / F.col("total")).alias("share"))


def converge(field: DataFrame) -> DataFrame:
    """Ties i, j, bi, bj, share: the one or two receivers of the steepest triangle around a post (``flow_shares``)."""
    two = F.explode(F.array(*(F.struct(F.col(f"i{n}").alias("bi"), F.col(f"j{n}").alias("bj"), F.col(f"share{n}").alias("share")) for n in (1, 2)))).alias("t")
    return flow_shares(field).select("i", "j", two).select("i", "j", "t.*").where("share > 0")


def channel(field: DataFrame) -> DataFrame:
    """Ties i, j, bi, bj, share: the direction that the surface falls in (by central differences, one-sided at an edge), split between the straight and
    the diagonal neighbour on its two sides. Where one of these isn't lower, or nothing falls, the steepest lower neighbour takes all (``receivers``)."""
    ring = {(x, y): f"v{k}" for k, (x, y) in enumerate([(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)])}
    dx, dy = F.col("b.i") - F.col("a.i"), F.col("b.j") - F.col("a.j")
    at = neighbours(field).groupBy("a", "va").agg(*(F.max(F.when((dx == x) & (dy == y), F.col("vb"))).alias(v) for (x, y), v in ring.items()))
    there = lambda x, y: F.col(ring[x, y]).isNotNull().cast("int")
    or_own = lambda x, y: F.coalesce(F.col(ring[x, y]), F.col("va"))
    fall = lambda x, y: (or_own(-x, -y) - or_own(x, y)) / F.nullif(there(x, y) + there(-x, -y), F.lit(0))
    fx, fy = F.col("fx"), F.col("fy")
    at = at.withColumns({"fx": fall(1, 0), "fy": fall(0, 1)}).where("(fx != 0 or fy != 0) and fx is not null and fy is not null")
    along = F.abs(fx) >= F.abs(fy)
    big, small = F.greatest(F.abs(fx), F.abs(fy)), F.least(F.abs(fx), F.abs(fy))
    sx, sy = F.signum(fx).cast("int"), F.signum(fy).cast("int")
    lower = lambda x, y: F.coalesce(F.element_at(F.create_map(*(c for (p, q), v in ring.items() for c in (F.lit(3 * p + q), F.col(v)))), 3 * x + y) < F.col("va"), F.lit(False))
    # Straight on, either diagonal will do as the other side, and of a diagonal either straight neighbour.
    ax, ay = F.when(along, sx).otherwise(F.lit(0)), F.when(along, F.lit(0)).otherwise(sy)
    straight, even = small == 0, F.abs(fx) == F.abs(fy)
    beside = F.when(straight, F.when(along, lower(sx, F.lit(1)) | lower(sx, F.lit(-1))).otherwise(lower(F.lit(1), sy) | lower(F.lit(-1), sy))).otherwise(lower(sx, sy))
    ahead = F.when(even, lower(sx, F.lit(0)) | lower(F.lit(0), sy)).otherwise(lower(ax, ay))
    a, b = big - small, small * F.sqrt(F.lit(2.0))
    tie = lambda x, y, w: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), (w / (a + b)).alias("share"))
    split = at.where(ahead & beside).select("a", F.explode(F.array(tie(ax, ay, a), tie(sx, sy, b))).alias("t")).where("t.share > 0")
    split = materialize(split.select("a", F.struct((F.col("a.i") + F.col("t.x")).alias("i"), (F.col("a.j") + F.col("t.y")).alias("j")).alias("b"), F.col("t.share").alias("share")), "split")
    alone = receivers(field).join(split.select("a").distinct(), "a", "left_anti").select("a", "b", F.lit(1.0).alias("share"))
    return split.unionByName(alone).select("a.i", "a.j", F.col("b.i").alias("bi"), F.col("b.j").alias("bj"), "share")


def hybrid(field: DataFrame, discharge: DataFrame, least: float, exponent: float = 1.1, spacing: float = 1.0) -> DataFrame:
    """Ties of posts with a discharge (i, j, discharge, and, if there is such a column, not flooded) of at least ``least`` are those of a channel;
    all others spread."""
    channels = discharge.where(F.col("discharge") >= least)
    channels = (channels.where(~F.coalesce("flooded", F.lit(False))) if "flooded" in discharge.columns else channels).select("i", "j")
    narrow = materialize(channel(field).join(channels, ["i", "j"], "left_semi"), "narrow")
    return spread(field, exponent, spacing).join(narrow.select("i", "j").distinct(), ["i", "j"], "left_anti").unionByName(narrow)


def downstream(posts: DataFrame, ties: DataFrame, fold: Fold, side: int = 256) -> DataFrame:
    """i, j, inflow, kept, out of each post: ``fold`` from the heights down. posts: i, j and columns of numbers for ``fold``; ties: i, j, bi, bj,
    share. What a post sends on is dealt by the shares of its ties; a post without ties sends nothing further. A ring of ties is an error.

    Sums are in the order of levels and posts, so that results don't depend on how rows lie, nor on rounds.
    """
    names = [c for c in posts.columns if c not in ("i", "j")]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        kind = rows["kind"].to_numpy()
        own = rows[kind == 0].sort_values(["i", "j"])
        n, place = len(own), pd.MultiIndex.from_arrays([own["i"], own["j"]])
        tied = rows[kind == 1].sort_values(["i", "j", "bi", "bj"])
        src, dst = (place.get_indexer(pd.MultiIndex.from_arrays([tied[a].astype("int64"), tied[b].astype("int64")])) for a, b in (("i", "j"), ("bi", "bj")))
        waits = np.bincount(dst[dst >= 0], minlength=n)
        came = rows[kind == 2].sort_values(["i", "j", "bi", "bj"])
        to = place.get_indexer(pd.MultiIndex.from_arrays([came["bi"].astype("int64"), came["bj"].astype("int64")]))
        came, to = came[to >= 0], to[to >= 0]
        inflow, low = np.zeros(n), np.full(n, np.inf)
        np.add.at(inflow, to, came["flux"].to_numpy(float))
        np.minimum.at(low, to, came["mark"].to_numpy(float))
        np.subtract.at(waits, to, 1)
        sends = np.flatnonzero(src >= 0)
        sends = sends[np.argsort(src[sends], kind="stable")]
        first = np.append(0, np.cumsum(np.bincount(src[sends], minlength=n)))
        target, share = dst[sends], tied["share"].to_numpy(float)[sends]
        values = {c: own[c].to_numpy(float) for c in names}
        kept, out, mark, done = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        flux, passed = np.zeros(len(sends)), np.zeros(len(sends), bool)
        ready = np.flatnonzero(waits == 0)
        while len(ready):
            kept[ready], out[ready], mark[ready] = fold({c: v[ready] for c, v in values.items()}, inflow[ready], low[ready])
            done[ready] = True
            count = first[ready + 1] - first[ready]
            at = np.repeat(first[ready] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            frm = np.repeat(ready, count)
            flux[at], passed[at] = out[frm] * share[at], True
            inside = target[at] >= 0
            met = target[at][inside]
            np.add.at(inflow, met, flux[at][inside])
            np.minimum.at(low, met, mark[frm][inside])
            np.subtract.at(waits, met, 1)
            met = np.unique(met)
            ready = met[waits[met] == 0]
        done_rows = pd.DataFrame({"kind": 0, "i": own["i"].to_numpy()[done], "j": own["j"].to_numpy()[done], "bi": 0, "bj": 0, "flux": inflow[done], "mark": mark[done], "kept": kept[done], "out": out[done]})
        leaves = np.flatnonzero(passed & (target < 0))
        gone = tied.iloc[sends[leaves]]
        sent = pd.DataFrame({"kind": 2, "i": gone["i"].to_numpy(), "j": gone["j"].to_numpy(), "bi": gone["bi"].to_numpy(), "bj": gone["bj"].to_numpy(), "flux": flux[leaves], "mark": mark[src[sends[leaves]]], "kept": 0.0, "out": 0.0})
        return pd.concat([done_rows, sent], ignore_index=True)

    tile = lambda i, j: F.struct(F.floor(F.col(i) / side).alias("ti"), F.floor(F.col(j) / side).alias("tj"))
    number = lambda c: F.col(c).cast("double").alias(c)
    place = [F.col(c).cast("long").alias(c) for c in ("i", "j")]
    heights = posts.select(tile("i", "j").alias("t"), F.lit(0).alias("kind"), *place, *map(number, names))
    edges = ties.select(F.explode(F.array_distinct(F.array(tile("i", "j"), tile("bi", "bj")))).alias("t"), F.lit(1).alias("kind"), *place, F.col("bi").cast("long").alias("bi"), F.col("bj").cast("long").alias("bj"), number("share"))
    given = materialize(heights.unionByName(edges, allowMissingColumns=True).select("t.ti", "t.tj", "*").drop("t"), "given")
    if given.where("kind = 0").isEmpty():
        return given.selectExpr("i", "j", "share as inflow", "share as kept", "share as out")
    schema = "kind int, i long, j long, bi long, bj long, flux double, mark double, kept double, out double"
    active, found, came, n, past = given.select("ti", "tj").distinct(), None, None, 0, [given]
    while True:
        work = given.join(active, ["ti", "tj"], "left_semi")
        if came is not None:
            work = work.unionByName(came.join(active, ["ti", "tj"], "left_semi"), allowMissingColumns=True)
        else:
            work = work.withColumns({"flux": F.lit(None).cast("double"), "mark": F.lit(None).cast("double")})
        n += 1
        solved = materialize(work.groupBy("ti", "tj").applyInPandas(solve, schema).withColumn("n", F.lit(n)), "solved")
        past.append(solved)
        results = solved.where("kind = 0").select("i", "j", "flux", "kept", "out", "n")
        found = results if found is None else found.unionByName(results)
        fresh = solved.where("kind = 2").select(F.lit(2).alias("kind"), "i", "j", "bi", "bj", "flux", "mark")
        if came is not None:
            fresh = fresh.join(came, ["i", "j", "bi", "bj"], "left_anti")
        fresh = materialize(fresh.select(tile("bi", "bj").alias("t"), "*").select("t.ti", "t.tj", "*").drop("t"), "came")
        if fresh.isEmpty():
            break
        active = materialize(fresh.select("ti", "tj").distinct(), "active")
        came = fresh if came is None else came.unionByName(fresh)
        if n % 8 == 0:  # plans stay short
            came, found = materialize(came, "came"), materialize(_latest(found), "found")
    total = materialize(_latest(found), "downstream")
    if total.count() != given.where("kind = 0").count():
        raise ValueError("flow.cycle: ties lead back to where they come from")
    for table in past:
        drop_table(table)
    return total.select("i", "j", F.col("flux").alias("inflow"), "kept", "out")


def _latest(found: DataFrame) -> DataFrame:
    return found.groupBy("i", "j").agg(F.max_by(F.struct("flux", "kept", "out"), "n").alias("r"), F.max("n").alias("n")).select("i", "j", "r.*", "n")


def discharge(field: DataFrame, ties: DataFrame, weight: Column, side: int = 256) -> DataFrame:
    """i, j, discharge: each post's own weight and all that comes from upstream by the shares of ties."""

    def fold(own: dict[str, np.ndarray], inflow: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(len(inflow)), own["weight"] + inflow, low

    return downstream(field.select("i", "j", weight.alias("weight")), ties, fold, side).select("i", "j", F.col("out").alias("discharge"))


def route_sediment(field: DataFrame, ties: DataFrame, keep: float, channel: float, area: float = 1.0, margin: float = 1e-6, side: int = 256) -> DataFrame:
    """i, j, value (the height after), deposited (depth), passed (volume that is sent on; from a post without ties, out of the land).

    field: i, j, value, detached (depth), discharge, water (level over a flooded post; null: dry). A flooded post keeps what comes until it stands at
    the water's level. A dry one with a discharge of at least ``channel`` keeps the share keep / discharge of what comes, but stays ``margin`` under
    its lowest donor's height after its own deposit. Others keep nothing. A post without ties is a base and keeps nothing either. No volume is lost.
    """
    based = field.join(ties.select("i", "j").distinct().withColumn("sends", F.lit(1)), ["i", "j"], "left")
    columns = based.select("i", "j", "value", "detached", "discharge", F.coalesce(F.col("water").cast("double"), F.lit(float("-inf"))).alias("water"), F.coalesce("sends", F.lit(0)).alias("sends"))

    def fold(own: dict[str, np.ndarray], inflow: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = own["value"]
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(own["discharge"] > 0, np.minimum(keep / own["discharge"], 1.0), 1.0)
        # Without a donor nothing comes, so that there is nothing to keep.
        room = np.where(np.isfinite(low), np.maximum(np.where(np.isfinite(low), low, 0.0) - margin - z, 0.0) * area, 0.0)
        wet = np.isfinite(own["water"])
        drowned = np.minimum(inflow, np.maximum(np.where(wet, own["water"], z) - z, 0.0) * area)
        dry = np.where(own["discharge"] >= channel, np.minimum(inflow * part, room), 0.0)
        kept = np.where(own["sends"] > 0, np.where(wet, drowned, dry), 0.0)
        return kept, inflow - kept + own["detached"] * area, z + kept / area

    run = downstream(columns, ties, fold, side)
    return field.select("i", "j", "value").join(run, ["i", "j"]).select("i", "j", (F.col("value") + F.col("kept") / area).alias("value"), (F.col("kept") / area).alias("deposited"), F.col("out").alias("passed"))
