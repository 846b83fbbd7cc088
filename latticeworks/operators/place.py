"""Placement: lattices thinned by a density, members along lines, groups in frames, and curves through points.

Every random value is a draw keyed by place, so no row depends on another, on their order, or on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_words, stream, to_unit
from ..storage import spread
from .spatial import interpolate, turned

MILLION = 1_000_000


def high_product(words: np.ndarray, times: np.ndarray | int) -> np.ndarray:
    """(word * times) >> 64, exact, for times below 2**32."""
    times = np.asarray(times, np.uint64)
    top, low = words >> np.uint64(32), words & np.uint64(0xFFFFFFFF)
    return ((top * times + (low * times >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def facing_parts(face: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine of millidegrees, by quadrant, so that the axes are exact."""
    q, a = face // 90_000, (face % 90_000).astype(float) * (math.pi / 180_000.0)
    s, c = np.sin(a), np.cos(a)
    return np.choose(q, [s, c, -s, -c]) + 0.0, np.choose(q, [c, -s, -c, s]) + 0.0


@dataclass(frozen=True)
class Scatter:
    """``assets``: pairs of an asset (or a list of alternatives that share its weight) and a weight in millionths. ``jitter`` in millionths.
    ``members``: least and most members of a clump within ``radius`` (mm) of each kept candidate."""

    name: str
    spacing: int
    assets: tuple[tuple[str | tuple[str, ...], int], ...]
    jitter: int = 800_000
    scale: tuple[float, float] = (1.0, 1.0)
    members: tuple[int, int] = (0, 0)
    radius: int = 0
    shrink: float = 0.0
    seed: str | None = None
    world_seed: int = 0

    def stream(self, purpose: str) -> int:
        return stream(self.world_seed, ["rule", self.seed or self.name, purpose])

    def chosen(self, words: np.ndarray) -> np.ndarray:
        """The first entry whose running weight exceeds the target, and an equal share of it for each of its alternatives."""
        weights = np.array([w for _, w in self.assets], np.int64)
        ends = np.cumsum(weights)
        target = high_product(words, int(ends[-1]))
        entry = np.searchsorted(ends, target, side="right")
        out = np.empty(len(words), object)
        for e, (own, w) in enumerate(self.assets):
            names = np.array(sorted(own) if isinstance(own, tuple) else [own], object)
            here = np.flatnonzero(entry == e)
            out[here] = names[(target[here] - (ends[e] - w)) * len(names) // w]
        return out


_ROWS = "key string, i long, j long, member long, asset string, x_mm long, y_mm long, face long, scale double"


def candidates(spark: SparkSession, s: Scatter, box: tuple[int, int, int, int]) -> DataFrame:
    """One candidate a lattice cell (i, j, x_mm, y_mm, u) whose point is in the closed box; u is its keep draw."""
    x0, y0, x1, y1 = box
    i0, j0, nx, ny = x0 // s.spacing, y0 // s.spacing, x1 // s.spacing - x0 // s.spacing + 1, y1 // s.spacing - y0 // s.spacing + 1
    width = s.spacing * s.jitter // MILLION
    streams = {p: s.stream(p) for p in ("jitter_x", "jitter_y", "keep")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i, j = b["id"].to_numpy() % nx + i0, b["id"].to_numpy() // nx + j0
            x, y = (c * s.spacing + (s.spacing - width) // 2 + high_product(draw_words(streams[p], i, j), width) for c, p in ((i, "jitter_x"), (j, "jitter_y")))
            out = pd.DataFrame({"i": i, "j": j, "x_mm": x, "y_mm": y, "u": to_unit(draw_words(streams["keep"], i, j))})
            yield out[(x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)]

    return spark.range(nx * ny).mapInPandas(run, "i long, j long, x_mm long, y_mm long, u double")


def scatter(spark: SparkSession, s: Scatter, box: tuple[int, int, int, int], density: Column, keep_out: Column | None = None, near: Column | None = None) -> DataFrame:
    """Instances of a scatter: key, i, j, member (-1 for a parent), asset, x_mm, y_mm, face (millidegrees), scale.

    ``density``, ``keep_out`` and ``near`` are columns over x_mm and y_mm. A density outside 0 to 1 is an error.
    """
    checked = F.when((density >= 0) & (density <= 1), density).otherwise(F.raise_error(F.lit("formula.range: density")).cast("double"))
    p = checked * (F.lit(1.0) - (keep_out if keep_out is not None else F.lit(0.0))) * (near if near is not None else F.lit(1.0))
    kept = candidates(spark, s, box).where(F.col("u") < p)
    streams = {n: s.stream(n) for n in ("asset", "face", "scale", "clump_count", "member_r", "member_a", "member_keep", "member_face", "member_scale")}
    low, high = s.scale
    x0, y0, x1, y1 = box

    def key(i: np.ndarray, j: np.ndarray) -> list[str]:
        plain = lambda v: f"n{-v}" if v < 0 else str(v)
        return [f"s{s.spacing}_{plain(a)}_{plain(b)}" for a, b in zip(i.tolist(), j.tolist())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i, j = b["i"].to_numpy(), b["j"].to_numpy()
            asset, keys = s.chosen(draw_words(streams["asset"], i, j)), np.array(key(i, j), object)
            parents = pd.DataFrame({"key": keys, "i": i, "j": j, "member": -1, "asset": asset, "x_mm": b["x_mm"], "y_mm": b["y_mm"], "face": high_product(draw_words(streams["face"], i, j), 360_000), "scale": low + to_unit(draw_words(streams["scale"], i, j)) * (high - low)})
            parents["pass"] = 0.0
            yield parents
            least, most = s.members
            if not most:
                continue
            count = least + high_product(draw_words(streams["clump_count"], i, j), most - least + 1)
            row = np.repeat(np.arange(len(i)), count)
            m = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            where = (i[row], j[row], m)
            r = s.radius * np.sqrt(to_unit(draw_words(streams["member_r"], *where)))
            sn, cs = facing_parts(high_product(draw_words(streams["member_a"], *where), 360_000))
            x, y = b["x_mm"].to_numpy()[row] + np.rint(r * sn).astype(np.int64), b["y_mm"].to_numpy()[row] + np.rint(r * cs).astype(np.int64)
            scale = (low + to_unit(draw_words(streams["member_scale"], *where)) * (high - low)) * (1 - s.shrink)
            own = pd.DataFrame({"key": [f"{k}_m{n}" for k, n in zip(keys[row], m)], "i": where[0], "j": where[1], "member": m, "asset": asset[row], "x_mm": x, "y_mm": y, "face": high_product(draw_words(streams["member_face"], *where), 360_000), "scale": scale, "pass": to_unit(draw_words(streams["member_keep"], *where))})
            yield own[(x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)]

    made = kept.select("i", "j", "x_mm", "y_mm").mapInPandas(run, _ROWS + ", pass double")
    out = F.lit(1.0) if keep_out is None else F.lit(1.0) - keep_out
    return made.where(F.col("pass") < out).drop("pass")


def stations(lines: DataFrame, by: str, count: int | None = None, spacing: int | None = None, ends: str = "half", span: tuple[float, float] = (0.0, 1.0), offset: int = 0) -> DataFrame:
    """Members of runs along lines (segments of paths): by, k, s (whole mm along the line), offset."""
    if (count is None) == (spacing is None) or ends not in ("half", "both"):
        raise ValueError("doc.type: a run takes a count or a spacing, and ends `half` or `both`")
    whole = lines.groupBy(by).agg(F.rint(F.max(F.col("before") + F.col("length"))).cast("long").alias("whole"))
    cut = whole.select(by, F.rint(F.lit(span[0]) * F.col("whole")).cast("long").alias("a"), F.rint(F.lit(span[1]) * F.col("whole")).cast("long").alias("b")).withColumn("free", F.col("b") - F.col("a")).where("free > 0")
    rounded = F.expr(f"(2 * free + {spacing}) div (2 * {spacing})") if spacing else None
    n = F.lit(count).cast("long") if count else F.greatest(rounded, F.lit(1)) if ends == "half" else F.greatest(rounded + 1, F.lit(2))
    placed = cut.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    s = F.expr("a + (2 * k + 1) * free div (2 * n)") if ends == "half" else F.expr("a + k * free div (n - 1)")
    return placed.select(by, "k", s.cast("long").alias("s"), F.lit(offset).alias("offset"))


def run_members(lines: DataFrame, by: str, **how: object) -> DataFrame:
    """Members with their points and bearings: by, k, s, x_mm, y_mm, face. A member at a line's very end is held by its last segment."""
    last = F.max("k").over(Window.partitionBy(by))
    open_end = lines.withColumn("length_", F.col("length")).withColumn("is_last", F.col("k") == last)
    at = stations(lines, by, **how).withColumnRenamed("k", "member")
    ends = open_end.groupBy(by).agg(F.max_by(F.struct("before", "length"), "k").alias("e")).select(by, (F.col("e.before") + F.col("e.length")).alias("whole"), F.col("e.before").alias("last_before"), F.col("e.length").alias("last_length"))
    held = at.join(ends, by).withColumn("s_mm", F.col("s")).withColumn("s", F.least(F.col("s").cast("double"), F.col("last_before") + F.col("last_length") * (1 - 1e-12)))
    placed = interpolate(held.select(by, "member", "s_mm", "s", "offset"), lines, by)
    return placed.select(by, F.col("member").alias("k"), F.col("s_mm").alias("s"), "x_mm", "y_mm", "face")


def set_items(places: DataFrame, items: DataFrame) -> DataFrame:
    """Items of a set (set, name, asset, dx, dy, turn) in the frames of places (set, maker, x_mm, y_mm, face in whole quarter turns): name, asset, x_mm, y_mm, face."""
    met = places.join(items, "set")
    x, y = turned(F.col("dx"), F.col("dy"), F.col("face"))
    return met.select(F.concat_ws("#", "maker", "name").alias("name"), "asset", (F.col("x_mm") + x).alias("x_mm"), (F.col("y_mm") + y).alias("y_mm"), F.pmod(F.col("face") + F.col("turn"), F.lit(360_000)).alias("face"))


def smooth(points: list[tuple[int, int]], step: int = 250) -> list[tuple[int, int]]:
    """A centripetal Catmull-Rom curve through points (Yuksel, Schaefer and Keyser, 2011), as a polyline on the lattice that keeps them;
    of points that repeat one after another, one stays."""
    points = [p for k, p in enumerate(points) if not k or p != points[k - 1]]
    if len(points) < 3:
        return points
    p = np.array([2 * np.array(points[0]) - points[1], *points, 2 * np.array(points[-1]) - points[-2]], float)
    knots = np.append(0.0, np.cumsum(np.sqrt(np.hypot(*np.diff(p, axis=0).T))))
    out = [points[0]]
    for k in range(1, len(points)):
        a, b, c, d = p[k - 1 : k + 3]
        ta, tb, tc, td = knots[k - 1 : k + 3]
        n = max(1, math.ceil(math.hypot(*(c - b)) / step))
        t = (tb + (tc - tb) * np.arange(1, n) / n)[:, None]
        blend = lambda u, v, lo, hi, t=t: (hi - t) / (hi - lo) * u + (t - lo) / (hi - lo) * v
        ab, bc, cd = blend(a, b, ta, tb), blend(b, c, tb, tc), blend(c, d, tc, td)
        for q in map(tuple, np.rint(blend(blend(ab, bc, ta, tc), blend(bc, cd, tb, td), tb, tc)).astype(int).tolist()):
            if q != out[-1]:
                out.append(q)
        if points[k] != out[-1]:
            out.append(points[k])
    return out


def smooth_paths(vertices: DataFrame, by: str, order: str, step: int = 250) -> DataFrame:
    """Paths replaced by curves through their vertices: by, n, x_mm, y_mm."""
    paths = vertices.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "x_mm", "y_mm"))).alias("points"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, x, y) for p, own in zip(b[by], b["points"]) for n, (x, y) in enumerate(smooth([(int(v["x_mm"]), int(v["y_mm"])) for v in own], step))]
            yield pd.DataFrame(rows, columns=[by, "n", "x_mm", "y_mm"])

    return spread(paths).mapInPandas(run, f"{by} {vertices.schema[by].dataType.simpleString()}, n long, x_mm long, y_mm long")


def cells(lines: DataFrame, by: str, width: int, depth: int) -> DataFrame:
    """Cells along the left of lines: bands ``depth`` deep, divided evenly at about every ``width`` mm; by, k, frontage, and corners as a ring of
    four points. A cell that a bend cuts short keeps its four corners."""
    whole = lines.groupBy(by).agg(F.floor(F.max(F.col("before") + F.col("length"))).cast("long").alias("whole")).where("whole > 0")
    cut = whole.withColumn("n", F.greatest(F.expr(f"(2 * whole + {width}) div (2 * {width})"), F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    ends = cut.select(by, "k", F.expr("k * whole div n").alias("a"), F.expr("(k + 1) * whole div n").alias("b"))
    spots = ends.select(by, "k", "a", "b", F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), F.col(e).cast("double").alias("s"), F.lit(o).alias("offset")) for c, e, o in ((0, "a", 0), (1, "b", 0), (2, "b", depth), (3, "a", depth))))).alias("c"))
    last = lines.groupBy(by).agg(F.max(F.col("before") + F.col("length")).alias("end"))
    held = spots.select(by, "k", "a", "b", "c.corner", "c.s", "c.offset").join(last, by).withColumn("s", F.least("s", F.col("end") * (1 - 1e-12))).drop("end")
    placed = interpolate(held, lines.drop("k"), by)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("corner", "x_mm", "y_mm"))), lambda p: F.struct(p["x_mm"].alias("x"), p["y_mm"].alias("y")))
    return placed.groupBy(by, "k").agg(F.max(F.col("b") - F.col("a")).alias("frontage"), ring.alias("ring"))


def follow(lines: DataFrame, by: str, step: int, offset: int) -> DataFrame:
    """A path beside each line, ``offset`` to its left (to its right if below 0): by, n, x_mm, y_mm, at about every ``step`` mm and both ends."""
    placed = run_members(lines, by, spacing=step, ends="both", offset=offset)
    w = Window.partitionBy(by).orderBy("k")
    moved = placed.withColumn("same", (F.lag("x_mm").over(w) == F.col("x_mm")) & (F.lag("y_mm").over(w) == F.col("y_mm")))
    return moved.where(~F.coalesce("same", F.lit(False))).select(by, (F.row_number().over(w) - 1).cast("long").alias("n"), "x_mm", "y_mm")
