"""Spatial operators on a millimetre lattice. Distances are compared squared and exact, as whole numbers.

Joins by place are equi-joins on square tiles: a side is dealt to every tile that an answer could lie in.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_table, materialize


def squared(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)


def tile(c: Column, size: int) -> Column:
    return F.floor(c / size)


def _around(points: DataFrame, size: int) -> DataFrame:
    """Each point in its own tile and the eight around it."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return points.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step)).withColumns({"tx": tile(F.col("x_mm"), size) + F.col("__dx"), "ty": tile(F.col("y_mm"), size) + F.col("__dy")}).drop("__dx", "__dy")


def _sites(sites: DataFrame, size: int) -> DataFrame:
    return sites.select(F.col("id").alias("site"), F.col("x_mm").alias("sx"), F.col("y_mm").alias("sy"), tile(F.col("x_mm"), size).alias("tx"), tile(F.col("y_mm"), size).alias("ty"))


def within_radius(points: DataFrame, sites: DataFrame, radius: int) -> DataFrame:
    """Pairs of a point and a site at most ``radius`` apart: id, site, d2."""
    near = _around(points, radius).join(_sites(sites, radius), ["tx", "ty"])
    return near.withColumn("d2", squared(F.col("x_mm"), F.col("y_mm"), F.col("sx"), F.col("sy"))).where(F.col("d2") <= radius * radius).select("id", "site", "d2")


def nearest(points: DataFrame, sites: DataFrame, extent: int, first: int, grow: int = 4, scale: int | None = None) -> DataFrame:
    """The nearest site of each point, ties by site: id, site, d2. With a ``scale``, the site of the least d2 * scale + site, ties by d2.

    Tiles of one size answer the points whose nearest site is within that size; the others go on to larger tiles, until tiles hold the extent. The first size is
    ``first``, or less, so that a tile holds some two sites if they are spread evenly. Places, not rows, are met: of sites at one place the least counts.
    """
    rows = points.select("id", "x_mm", "y_mm")
    spots = sites.groupBy("x_mm", "y_mm").agg(F.min("id").alias("id")).where("x_mm is not null and y_mm is not null")
    spots = materialize(spots, "sites")
    n, x0, x1, y0, y1, least = spots.agg(F.count("*"), F.min("x_mm"), F.max("x_mm"), F.min("y_mm"), F.max("y_mm"), F.min("id") if scale else F.lit(0)).first()
    size = min(first, max(1, math.isqrt(2 * max(x1 - x0, 1) * max(y1 - y0, 1) // n))) if n else extent
    left = materialize(rows.select("x_mm", "y_mm").where("x_mm is not null and y_mm is not null").distinct(), "left")
    out: list[DataFrame] = []
    while True:
        near = _around(left.withColumns({"px": F.col("x_mm"), "py": F.col("y_mm")}), size).join(_sites(spots, size), ["tx", "ty"]).withColumn("d2", squared(F.col("x_mm"), F.col("y_mm"), F.col("sx"), F.col("sy")))
        rank = F.struct(*([(F.col("d2") * scale + F.col("site")).alias("rank")] if scale else []), "d2", "site")
        sure = near.groupBy("px", "py").agg(F.min(rank).alias("b"))
        if size < extent:  # what lies beyond the tiles around is farther than a tile
            sure = sure.where(F.col("b.rank") <= size * size * scale + least if scale else F.col("b.d2") <= size * size)
        out.append(materialize(sure.select("px", "py", "b.d2", "b.site"), "nearest"))
        if size >= extent:
            break
        after = materialize(left.join(out[-1], (F.col("x_mm") == F.col("px")) & (F.col("y_mm") == F.col("py")), "left_anti"), "left")
        drop_table(left)
        left, size = after, min(size * grow, extent)
        if left.isEmpty():
            break
    found = out[0]
    for t in out[1:]:
        found = found.unionByName(t)
    met = rows.join(found, (F.col("x_mm") == F.col("px")) & (F.col("y_mm") == F.col("py")))
    rank = F.struct(*([(F.col("d2") * scale + F.col("site")).alias("rank")] if scale else []), "d2", "site")
    return met.groupBy("id").agg(F.min(rank).alias("b")).select("id", F.col("b.site").alias("site"), F.col("b.d2").alias("d2"))


#: What a point of a tile is: not decided, staying, or gone.
OPEN, STAYS, GONE = 0, 1, 2


def _settled(x: np.ndarray, y: np.ndarray, state: np.ndarray, whole: np.ndarray, radius: int) -> np.ndarray:
    """States of points, given in order. Only of a ``whole`` one all that are near are here; what hangs on others stays open."""
    out = state.copy()
    near = lambda k, which: squared(x[which], y[which], x[k], y[k]) <= radius * radius
    todo, unsure = np.flatnonzero(out == OPEN), np.zeros(len(x), bool)
    for k in np.flatnonzero(out == STAYS):
        hit = near(k, todo)
        out[todo[hit]] = GONE
        todo = todo[~hit]
    while len(todo):
        k, todo = todo[0], todo[1:]
        hit = near(k, todo)
        if whole[k] and not unsure[k]:
            out[k], out[todo[hit]] = STAYS, GONE
            todo = todo[~hit]
        else:
            unsure[todo[hit]] = True
    return out


def thinned(points: DataFrame, radius: int, order: list[str], among: str | None = None) -> DataFrame:
    """Ids of the points (id, x_mm, y_mm, the numbers of ``order``, and ``among``) that stay if, in ascending order (and by id), each goes that has one that
    stays within ``radius``, of its own ``among``. A point without a place, or without ``among``, has none near it. Of a place only the first can stay.

    Rounds over tiles, each with what lies around it: a tile settles its points in order, but for what hangs on points whose own surroundings reach beyond; these
    go on, with those that stay. The first point that is left is settled in each round. A task holds the places within 8 by 8 radii.
    """
    size, halo, keys = 4 * radius, 2 * radius, ["__among", "tx", "ty"]
    own = points.select((F.col(among) if among else F.lit(0)).alias("__among"), "x_mm", "y_mm", *order, "id")
    known = F.col("x_mm").isNotNull() & F.col("y_mm").isNotNull() & F.col("__among").isNotNull()
    places = own.where(known).groupBy("__among", "x_mm", "y_mm").agg(F.min(F.struct(*order, "id")).alias("b"))
    now = materialize(places.select("__among", "x_mm", "y_mm", *(F.col(f"b.{c}").alias(c) for c in dict.fromkeys([*order, "id"])), F.lit(OPEN).alias("state")), "places")
    shape = now.schema

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "id"], ignore_index=True)
        x, y, state = (rows[c].to_numpy() for c in ("x_mm", "y_mm", "state"))
        dx, dy = x - key[1] * size, y - key[2] * size
        inside = lambda d: (dx >= -d) & (dx < size + d) & (dy >= -d) & (dy < size + d)
        mine = inside(0)
        if (state[mine] == OPEN).any():
            state = _settled(x, y, state, inside(halo - radius), radius)
        return rows.assign(state=state)[mine & (state != GONE)][shape.names]

    reach = lambda c: F.explode(F.sequence(tile(F.col(c) - halo, size), tile(F.col(c) + halo, size)))
    while not now.where(F.col("state") == OPEN).isEmpty():
        after = materialize(now.withColumn("tx", reach("x_mm")).withColumn("ty", reach("y_mm")).groupBy(*keys).applyInPandas(run, shape), "places")
        drop_table(now)
        now = after
    return now.select("id").unionByName(own.where(~known).select("id"))


def clear(rows: DataFrame, discs: DataFrame, radius: int) -> DataFrame:
    """Rows that no disc holds."""
    return rows.join(within_radius(rows, discs, radius).select("id").distinct(), "id", "left_anti")


def in_boxes(points: DataFrame, boxes: DataFrame, size: int) -> DataFrame:
    """Pairs of a point and a closed box (name, x0, y0, x1, y1) that holds it."""
    tiles = boxes.withColumn("tx", F.explode(F.sequence(tile(F.col("x0"), size), tile(F.col("x1"), size)))).withColumn("ty", F.explode(F.sequence(tile(F.col("y0"), size), tile(F.col("y1"), size))))
    placed = points.withColumns({"tx": tile(F.col("x_mm"), size), "ty": tile(F.col("y_mm"), size)})
    return placed.join(tiles, ["tx", "ty"]).where("x_mm between x0 and x1 and y_mm between y0 and y1")


def in_regions(points: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """Points inside regions (name, ring: array of x, y), edges counting as inside: id, name. By exact winding numbers."""
    xs, ys = F.col("ring.x"), F.col("ring.y")
    boxed = regions.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    n = F.size("ring")
    near = in_boxes(points, boxed, size)

    def turn(i: Column) -> Column:
        a, b = F.get("ring", i), F.get("ring", F.pmod(i + 1, n))
        x, y = F.col("x_mm"), F.col("y_mm")
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        on = (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        wind = F.when((a["y"] <= y) & (b["y"] > y) & (cross > 0), 1).when((a["y"] > y) & (b["y"] <= y) & (cross < 0), -1).otherwise(0)
        return F.struct(on.alias("on"), wind.alias("wind"))

    turns = F.transform(F.sequence(F.lit(0), n - 1), turn)
    wound = near.withColumn("turns", turns)
    return wound.where(F.exists("turns", lambda t: t["on"]) | (F.aggregate("turns", F.lit(0), lambda s, t: s + t["wind"]) != 0)).select("id", "name")


def segments(vertices: DataFrame, by: str, order: str) -> DataFrame:
    """Segments of paths of vertices (x_mm, y_mm): k, ax, ay, bx, by_, length, and the length before each."""
    w = Window.partitionBy(by).orderBy(order)
    out = vertices.select(by, F.col(order).alias("k"), F.col("x_mm").alias("ax"), F.col("y_mm").alias("ay"), F.lead("x_mm").over(w).alias("bx"), F.lead("y_mm").over(w).alias("by_")).where("bx is not null and (ax != bx or ay != by_)")
    out = out.withColumn("length", F.sqrt(squared(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_")).cast("double")))
    ahead = Window.partitionBy(by).orderBy("k")
    return out.withColumn("before", F.coalesce(F.sum("length").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def project(points: DataFrame, paths: DataFrame, by: str) -> DataFrame:
    """Each point (with its path) on the nearest segment of the path, ties to the earlier: id, path, d (mm), sd (left of travel is positive),
    and the length along the path."""
    met = points.join(paths, by)
    ux, uy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    wx, wy = F.col("x_mm") - F.col("ax"), F.col("y_mm") - F.col("ay")
    t = F.least(F.greatest((ux * wx + uy * wy).cast("double") / (ux * ux + uy * uy), F.lit(0.0)), F.lit(1.0))
    dx, dy = F.col("x_mm") - (F.col("ax") + t * ux), F.col("y_mm") - (F.col("ay") + t * uy)
    side = F.signum((ux * wy - uy * wx).cast("double"))
    rated = met.select("id", by, F.sqrt(dx * dx + dy * dy).alias("d"), side.alias("side"), (F.col("before") + t * F.col("length")).alias("along"), "k")
    best = rated.groupBy("id", by).agg(F.min(F.struct("d", "k", "side", "along")).alias("b"))
    return best.select("id", by, F.col("b.d").alias("d"), (F.col("b.d") * F.when(F.col("b.side") < 0, -1.0).otherwise(1.0)).alias("sd"), F.col("b.along").alias("along"))


def interpolate(stations: DataFrame, paths: DataFrame, by: str) -> DataFrame:
    """The lattice point at an arc length ``s`` of a path, offset to the left by ``offset``, and the bearing there (millidegrees)."""
    held = stations.join(paths, by).where("before <= s and s < before + length")
    f = (F.col("s") - F.col("before")) / F.col("length")
    dx, dy = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by_") - F.col("ay")).cast("double")
    x = F.rint(F.col("ax") + f * dx + F.col("offset") * (-dy / F.col("length"))).cast("long")
    y = F.rint(F.col("ay") + f * dy + F.col("offset") * (dx / F.col("length"))).cast("long")
    return held.select(*stations.columns, x.alias("x_mm"), y.alias("y_mm"), bearing(dx, dy).alias("face"))


def bearing(dx: Column, dy: Column) -> Column:
    """Millidegrees clockwise from north of a direction."""
    return F.pmod(F.rint(F.atan2(dx.cast("double"), dy.cast("double")) * F.lit(180000.0 / math.pi)).cast("long"), F.lit(360000))


def turned(x: Column, y: Column, face: Column) -> tuple[Column, Column]:
    """A local point in the frame of a facing of whole quarter turns (millidegrees), exact."""
    q = F.expr("1") * F.floor(F.pmod(face, F.lit(360000)) / 90000)
    return F.when(q == 0, x).when(q == 1, y).when(q == 2, -x).otherwise(-y), F.when(q == 0, y).when(q == 1, -x).when(q == 2, -y).otherwise(x)


def ring_measures(vertices: DataFrame, by: str, order: str) -> DataFrame:
    """Of closed rings: twice the signed area (exact), outline length, and bounding box."""
    w = Window.partitionBy(by).orderBy(order)
    first = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in ("x_mm", "y_mm"))
    sides = vertices.withColumns({"nx": nx, "ny": ny})
    cross = (F.col("x_mm") * F.col("ny") - F.col("nx") * F.col("y_mm")).cast("decimal(38,0)")
    return sides.groupBy(by).agg(F.sum(cross).cast("long").alias("area2"), F.sum(F.sqrt(squared(F.col("x_mm"), F.col("y_mm"), F.col("nx"), F.col("ny")).cast("double"))).alias("outline"), F.min("x_mm").alias("x0"), F.min("y_mm").alias("y0"), F.max("x_mm").alias("x1"), F.max("y_mm").alias("y1"))


def overlaps(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) whose interiors meet: a, b. Each pair is found in one tile, that of the corner of its overlap."""
    tiles = lambda d: d.withColumn("tx", F.explode(F.sequence(tile(F.col("x0"), size), tile(F.col("x1"), size)))).withColumn("ty", F.explode(F.sequence(tile(F.col("y0"), size), tile(F.col("y1"), size))))
    l, r = tiles(a).alias("l"), tiles(b).alias("r")
    met = l.join(r, (F.col("l.tx") == F.col("r.tx")) & (F.col("l.ty") == F.col("r.ty")))
    inside = (F.col("l.x0") < F.col("r.x1")) & (F.col("r.x0") < F.col("l.x1")) & (F.col("l.y0") < F.col("r.y1")) & (F.col("r.y0") < F.col("l.y1"))
    corner = (tile(F.greatest("l.x0", "r.x0"), size) == F.col("l.tx")) & (tile(F.greatest("l.y0", "r.y0"), size) == F.col("l.ty"))
    return met.where(inside & corner).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def along_segments(points: DataFrame, lines: DataFrame, radius: int) -> DataFrame:
    """Pairs of a point (id) and a segment (path, k) at most ``radius`` apart: id, path, k, d. Segments go to the tiles their box,
    grown by the radius, touches."""
    grown = lines.withColumns({"x0": F.least("ax", "bx") - radius, "x1": F.greatest("ax", "bx") + radius, "y0": F.least("ay", "by_") - radius, "y1": F.greatest("ay", "by_") + radius})
    size = max(radius * 4, 1)
    met = in_boxes(points, grown, size)
    ux, uy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    wx, wy = F.col("x_mm") - F.col("ax"), F.col("y_mm") - F.col("ay")
    t = F.least(F.greatest((ux * wx + uy * wy).cast("double") / (ux * ux + uy * uy), F.lit(0.0)), F.lit(1.0))
    dx, dy = wx - t * ux, wy - t * uy
    return met.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius).select("id", "path", "k", "d")


def bring(rows: DataFrame, prefix: str, x_mm: int, y_mm: int, face: int, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Another world's rows in this one's frame: points turned by whole quarters and moved, names under a prefix."""
    x, y = turned(F.col("x_mm"), F.col("y_mm"), F.lit(face))
    moved = rows.withColumns({"__x": x + x_mm, "__y": y + y_mm}).drop("x_mm", "y_mm").withColumnsRenamed({"__x": "x_mm", "__y": "y_mm"})
    return moved.withColumns({c: F.concat(F.lit(f"{prefix}."), F.col(c)) for c in columns})
