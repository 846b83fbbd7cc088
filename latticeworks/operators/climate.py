"""Rain and warmth over a raster (i, j, value), under a wind of one of eight directions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def blurred(field: DataFrame, value: str) -> DataFrame:
    """The mean of a post and those of its 8 neighbours that there are: each value is sent to nine places and summed there, in one shuffle."""
    to = F.explode(F.array(*(F.struct((F.col("i") + x).alias("i"), (F.col("j") + y).alias("j"), F.lit(x == 0 and y == 0).alias("own")) for x in (-1, 0, 1) for y in (-1, 0, 1))))
    sent = field.select(F.col(value).alias("v"), to.alias("to"))
    return sent.groupBy("to.i", "to.j").agg(F.avg("v").alias(value), F.bool_or("to.own").alias("own")).where("own").drop("own")


def precipitation(field: DataFrame, wind: tuple[int, int], sea: float, mean: float, spacing: float = 1.0, smooth: float = 4.0, evaporation: float = 0.2, convective: float = 0.02, orographic: float = 0.1, lines: int = 64) -> DataFrame:
    """i, j, rain: air comes in humid over the upwind edge and is followed along lines of the wind. Over the sea it takes up water and rains
    ``convective`` of it; over land it rains that and ``orographic`` for each 100 of height that the air, whose height follows the land's
    over a distance of ``smooth``, is lifted, and never more than it holds. Two blurs follow, and the mean over land becomes ``mean``.

    Lines are independent and folded ``lines`` at a time, as arrays, so a task holds so many lines of posts and no more.
    """
    dx, dy = wind
    if (dx, dy) == (0, 0) or max(abs(dx), abs(dy)) > 1:
        raise ValueError("climate.wind: one of the eight directions")
    line = F.col("i") * dy - F.col("j") * dx
    step = F.col("i") * dx if dx else F.col("j") * dy
    follow = 1.0 - float(np.exp(-spacing * float(np.hypot(dx, dy)) / smooth))

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["line"] - rows["line"].min(), rows["step"] - rows["step"].min()
        z = np.full((int(a.max()) + 1, int(b.max()) + 1), np.nan)
        z[a, b] = rows["value"]
        rain, humid, air = np.zeros_like(z), np.ones(len(z)), np.full(len(z), float(sea))
        for k in range(z.shape[1]):
            h = z[:, k]
            there, wet = np.isfinite(h), h < sea
            lifted = np.where(there, air + follow * (np.fmax(h, sea) - air), air)
            over_land = np.minimum((convective + orographic * (np.maximum(lifted - air, 0.0) / 100.0)) * humid, humid)
            taken = humid + evaporation * (1.0 - humid)
            rain[:, k] = np.where(wet, convective * taken, over_land)
            humid = np.where(there, np.where(wet, taken, humid - over_land), humid)
            air = lifted
        return pd.DataFrame({"i": rows["i"], "j": rows["j"], "value": rows["value"], "rain": rain[a, b]})

    placed = field.select("i", "j", F.col("value").cast("double").alias("value"), line.cast("long").alias("line"), step.cast("long").alias("step"))
    raw = placed.groupBy(F.floor(F.col("line") / lines)).applyInPandas(sweep, "i long, j long, value double, rain double")
    rain = materialize(blurred(blurred(raw, "rain"), "rain").join(field.select("i", "j", (F.col("value") >= sea).alias("land")), ["i", "j"]), "rain")
    over = rain.where("land").agg(F.avg("rain")).first()[0]
    return rain.select("i", "j", (F.col("rain") * (mean / over if over else 0.0)).alias("rain"))


def temperature(field: DataFrame, rows: int, sea: float, at_sea: float = 12.0, lapse: float = 6.5, across: float = 3.0, noise: Column | None = None) -> DataFrame:
    """i, j, warmth: ``at_sea`` degrees less ``lapse`` for each 1000 of height over the sea, ``across`` more from the first of ``rows`` rows to
    the last, and noise of 0.6 degrees."""
    warm = at_sea - lapse * F.greatest(F.col("value") - sea, F.lit(0.0)) / 1000.0 + across * ((F.col("j") + 0.5) / rows - 0.5)
    return field.select("i", "j", (warm + (0.6 * noise if noise is not None else F.lit(0.0))).alias("warmth"))
