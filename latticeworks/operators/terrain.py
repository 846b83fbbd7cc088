"""Land forms: incision, diffusion, repose and stream orders, over rasters (i, j, value).

Water stays in its basin, so what follows receivers is done basin by basin, in parallel; what spreads to neighbours is a join.
A basin is one task: its posts are bounded by the land that drains to one pit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .raster import basins, neighbours, receivers


def _drained(field: DataFrame) -> DataFrame:
    """i, j, value, the receiver (ri, rj; a pit's is itself), and the pit (pi, pj)."""
    down = receivers(field).select("a.i", "a.j", F.col("b.i").alias("ri"), F.col("b.j").alias("rj"))
    with_pit = field.join(basins(field), ["i", "j"])
    return with_pit.join(down, ["i", "j"], "left").withColumns({"ri": F.coalesce("ri", "i"), "rj": F.coalesce("rj", "j")})


def _stack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each row's receiver, and rows from the pit up, each after its receiver: receivers are strictly lower, so heights give the order."""
    at = {(i, j): k for k, (i, j) in enumerate(zip(rows["i"], rows["j"]))}
    to = np.array([at[p] for p in zip(rows["ri"], rows["rj"])])
    return to, np.lexsort((rows["i"], rows["j"], rows["value"]))


def erode(field: DataFrame, uplift: float, power: float, spread: float, exponent: float = 0.5) -> DataFrame:
    """One step: uplift everywhere but at pits; implicit incision by drained area along receivers (Braun and Willett, 2013); then explicit diffusion
    among four neighbours, which keeps the mass."""

    def incise(rows: pd.DataFrame) -> pd.DataFrame:
        to, order = _stack(rows)
        z, area = rows["value"].to_numpy().copy(), np.ones(len(rows))
        pit = to == np.arange(len(rows))
        z[~pit] += uplift
        for k in order[::-1]:
            if not pit[k]:
                area[to[k]] += area[k]
        far = np.hypot(rows["i"].to_numpy() - rows["ri"].to_numpy(), rows["j"].to_numpy() - rows["rj"].to_numpy())
        for k in order:
            if not pit[k]:
                f = power * area[k] ** exponent / far[k]
                z[k] = (z[k] + f * z[to[k]]) / (1 + f)
        return pd.DataFrame({"i": rows["i"], "j": rows["j"], "value": z})

    cut = materialize(_drained(field).groupBy("pi", "pj").applyInPandas(incise, "i long, j long, value double"), "cut")
    flow = neighbours(cut, 4).groupBy("a").agg(F.sum((F.col("vb") - F.col("va")) * spread).alias("gain"))
    return cut.join(flow.select("a.i", "a.j", "gain"), ["i", "j"], "left").select("i", "j", (F.col("value") + F.coalesce("gain", F.lit(0.0))).alias("value"))


def relax_slopes(field: DataFrame, repose: float, rounds: int) -> DataFrame:
    """Steps between four neighbours that are over ``repose`` give an eighth of what is over to the lower one, so many times; the mass stays."""
    now = field.select("i", "j", "value")
    for _ in range(rounds):
        over = F.greatest(F.abs(F.col("vb") - F.col("va")) - repose, F.lit(0.0)) / 8
        gain = neighbours(now, 4).groupBy("a").agg(F.sum(over * F.signum(F.col("vb") - F.col("va"))).alias("gain"))
        now = materialize(now.join(gain.select("a.i", "a.j", "gain"), ["i", "j"], "left").select("i", "j", (F.col("value") + F.coalesce("gain", F.lit(0.0))).alias("value")), "slopes")
    return now


def strahler(field: DataFrame) -> DataFrame:
    """i, j, order (of streams along receivers: one more where two of the highest order meet), steps to the pit."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        to, order = _stack(rows)
        n = len(rows)
        most, twice, steps = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        own = np.ones(n, np.int64)
        for k in order[::-1]:
            own[k] = max(most[k] + twice[k], 1)
            r = to[k]
            if r != k:
                if own[k] > most[r]:
                    most[r], twice[r] = own[k], False
                elif own[k] == most[r]:
                    twice[r] = True
        for k in order:
            if to[k] != k:
                steps[k] = steps[to[k]] + 1
        return pd.DataFrame({"i": rows["i"], "j": rows["j"], "order": own, "steps": steps})

    return _drained(field).groupBy("pi", "pj").applyInPandas(one, "i long, j long, order long, steps long")
