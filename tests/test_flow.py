"""Flows against plain loops from the heights down, with tiles so small that courses cross many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.operators import climate, flow


def land(spark, seed, nx=17, ny=13):
    rng = random.Random(seed)
    values = {(i, j): 3.0 * i + 2.0 * j + rng.random() for i in range(nx) for j in range(ny)}
    return values, spark.createDataFrame([(i, j, v) for (i, j), v in values.items()], "i long, j long, value double")


def spread(values, p, exponent):
    i, j = p
    down = {(i + x, j + y): ((values[p] - values[i + x, j + y]) / np.hypot(x, y)) ** exponent for x in (-1, 0, 1) for y in (-1, 0, 1) if (x or y) and values.get((i + x, j + y), np.inf) < values[p]}
    return {q: w / sum(down.values()) for q, w in down.items()}


def gathered(values, ties):
    total = dict.fromkeys(values, 1.0)
    for p in sorted(values, key=values.get, reverse=True):
        for q, share in ties.get(p, {}).items():
            total[q] += total[p] * share
    return total


@pytest.mark.parametrize("side", [6, 64])
def test_discharge_is_that_of_a_plain_loop(spark, side):
    values, df = land(spark, 1)
    for ties in (flow.spread(df), flow.converge(df)):
        by = {}
        for r in ties.collect():
            by.setdefault((r.i, r.j), {})[r.bi, r.bj] = r.share
        want = gathered(values, by)
        got = {(r.i, r.j): r.discharge for r in flow.discharge(df, ties, F.lit(1.0), side).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    plain = {p: spread(values, p, 1.1) for p in values}
    spreads = {(r.i, r.j, r.bi, r.bj): r.share for r in flow.spread(df).collect()}
    assert spreads.keys() == {(*p, *q) for p in plain for q in plain[p]} and all(abs(spreads[(*p, *q)] - w) < 1e-9 for p in plain for q, w in plain[p].items())


def channelled(values, p):
    """Of all pairs of a straight and a diagonal lower neighbour at 45 degrees, the one whose directions the fall is a sum of."""
    i, j = p
    fall = lambda x, y: (values.get((i - x, j - y), values[p]) - values.get((i + x, j + y), values[p])) / (((i - x, j - y) in values) + ((i + x, j + y) in values))
    f = np.array([fall(1, 0), fall(0, 1)])
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x or y) and values.get((i + x, j + y), np.inf) < values[p]]
    for s in steps:
        for d in steps:
            if 0 in s and 0 not in d and s[0] * d[0] + s[1] * d[1] > 0 and f.any():
                c = np.linalg.solve(np.array([s, np.array(d) / np.sqrt(2)]).T, f)
                c[abs(c) < 1e-12] = 0
                if (c >= 0).all():
                    return {(i + q[0], j + q[1]): w / c.sum() for q, w in zip((s, d), c) if w > 0}
    if not steps:
        return {}
    best = min(steps, key=lambda q: (-(values[p] - values[i + q[0], j + q[1]]) / np.hypot(*q), j + q[1], i + q[0]))
    return {(i + best[0], j + best[1]): 1.0}


def test_channels_follow_the_fall_and_slopes_spread(spark):
    values, df = land(spark, 2)
    rough = {p: float((7 * p[0] * p[0] + 5 * p[1] * p[0] + 3 * p[1]) % 23) for p in values}
    plane = {p: 2.0 * p[0] for p in values}
    for heights in (values, rough, plane):
        table = spark.createDataFrame([(i, j, v) for (i, j), v in heights.items()], "i long, j long, value double")
        want = {(*p, *q): w for p in heights for q, w in channelled(heights, p).items()}
        got = {(r.i, r.j, r.bi, r.bj): r.share for r in flow.channel(table).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-9 for k, w in want.items())
    run = flow.discharge(df, flow.spread(df), F.lit(1.0)).withColumn("flooded", F.col("i") == 3)
    wide = {(r.i, r.j) for r in run.where("discharge >= 6 and not flooded").collect()}
    got, want = {}, {p: channelled(values, p) if p in wide else spread(values, p, 1.1) for p in values}
    for r in flow.hybrid(df, run, 6.0).collect():
        got.setdefault((r.i, r.j), {})[r.bi, r.bj] = r.share
    assert wide and got.keys() == {p for p in want if want[p]} and all(got[p].keys() == want[p].keys() for p in got)


@pytest.mark.parametrize("side", [6, 64])
def test_sediment_is_that_of_a_plain_loop_and_none_is_lost(spark, side):
    values, df = land(spark, 3)
    ties = {p: spread(values, p, 1.1) for p in values}
    run = gathered(values, ties)
    water = {p: v + 0.4 for p, v in values.items() if sum(p) % 5 == 0}
    z, came, low, want = dict(values), dict.fromkeys(values, 0.0), dict.fromkeys(values, np.inf), {}
    for p in sorted(values, key=values.get, reverse=True):
        kept = 0.0
        if ties[p] and p in water:
            kept = min(came[p], max(water[p] - z[p], 0.0) * 2.0)
        elif ties[p] and run[p] >= 4.0 and np.isfinite(low[p]):
            kept = min(came[p] * min(1.5 / run[p], 1.0), max(low[p] - 1e-6 - z[p], 0.0) * 2.0)
        z[p] += kept / 2.0
        out = came[p] - kept + 0.25 * 2.0
        want[p] = (z[p], kept / 2.0, out)
        for q, share in ties[p].items():
            came[q] += out * share
            low[q] = min(low[q], z[p])
    rows = [(i, j, v, 0.25, float(run[i, j]), water.get((i, j))) for (i, j), v in values.items()]
    loose = spark.createDataFrame(rows, "i long, j long, value double, detached double, discharge double, water double")
    got = {(r.i, r.j): (r.value, r.deposited, r.passed) for r in flow.route_sediment(loose, flow.spread(df), 1.5, 4.0, area=2.0, side=side).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p], atol=1e-9) for p in want)
    left = sum(got[p][2] for p in got if not ties[p]) + sum(d * 2.0 for _, d, _ in got.values())
    assert abs(left - 0.25 * 2.0 * len(values)) < 1e-9 and sum(d > 0 for _, d, _ in got.values()) > 5


def test_rings_are_errors_and_empty_land_has_no_rows(spark):
    _, df = land(spark, 4, 2, 1)
    ring = spark.createDataFrame([(0, 0, 1, 0, 1.0), (1, 0, 0, 0, 1.0)], "i long, j long, bi long, bj long, share double")
    with pytest.raises(ValueError, match="flow.cycle"):
        flow.discharge(df, ring, F.lit(1.0))
    assert flow.discharge(df.limit(0), ring.limit(0), F.lit(1.0)).count() == 0


@pytest.mark.parametrize("wind", [(1, 0), (0, -1), (-1, 1)])
def test_rain_is_that_of_a_plain_walk(spark, wind):
    values, df = land(spark, 5, 9, 7)
    follow, sea, raw = 1 - np.exp(-np.hypot(*wind) / 4.0), 15.0, {}
    for start in values:
        if (start[0] - wind[0], start[1] - wind[1]) in values:
            continue
        p, humid, air = start, 1.0, sea
        while p in values:
            before, air = air, air + follow * (max(values[p], sea) - air)
            if values[p] < sea:
                humid += 0.2 * (1 - humid)
                raw[p] = 0.02 * humid
            else:
                raw[p] = min((0.02 + 0.1 * max(air - before, 0) / 100) * humid, humid)
                humid -= raw[p]
            p = (p[0] + wind[0], p[1] + wind[1])
    for _ in range(2):
        raw = {(i, j): np.mean([raw[i + x, j + y] for x in (-1, 0, 1) for y in (-1, 0, 1) if (i + x, j + y) in raw]) for i, j in raw}
    scale = 0.8 / np.mean([raw[p] for p in raw if values[p] >= sea])
    got = {(r.i, r.j): r.rain for r in climate.precipitation(df, wind, sea, 0.8, lines=3).collect()}
    assert got.keys() == raw.keys() and all(abs(got[p] - raw[p] * scale) < 1e-9 for p in raw)
