import random

from pyspark.sql import functions as F

from latticeworks.operators import terrain


def a_field(spark, seed, nx=12, ny=9):
    rng = random.Random(seed)
    rows = [(i, j, 10.0 * (i + 1) * (j + 1) + rng.randrange(40)) for i in range(nx) for j in range(ny)]
    return rows, spark.createDataFrame(rows, "i long, j long, value double")


def test_erosion_lowers_towards_receivers_and_diffusion_keeps_mass(spark):
    rows, df = a_field(spark, 1)
    still = {(r.i, r.j): r.value for r in terrain.erode(df, 0.0, 0.0, 0.0).collect()}
    assert still == {(i, j): v for i, j, v in rows}
    spread = terrain.erode(df, 0.0, 0.0, 0.1).agg(F.sum("value")).first()[0]
    assert abs(spread - sum(v for *_, v in rows)) < 1e-6
    cut = {(r.i, r.j): r.value for r in terrain.erode(df, 0.0, 0.5, 0.0).collect()}
    assert all(cut[i, j] <= v for i, j, v in rows) and sum(cut[i, j] < v for i, j, v in rows) > 80


def test_repose_keeps_mass_and_lowers_the_steepest_step(spark):
    rows, df = a_field(spark, 2)
    steep = lambda d: max(abs(d[p] - d[q]) for p in d for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in d)
    before = {(i, j): v for i, j, v in rows}
    after = {(r.i, r.j): r.value for r in terrain.relax_slopes(df, 50.0, 3).collect()}
    assert abs(sum(after.values()) - sum(before.values())) < 1e-6 and steep(after) < steep(before)


def test_strahler_of_a_fork(spark):
    """Two lines run together: each is of order 1, and below the fork of order 2."""
    values = {(0, 4): 9.0, (1, 3): 8.0, (4, 4): 9.0, (3, 3): 8.0, (2, 2): 7.0, (2, 1): 6.0, (2, 0): 5.0}
    got = {(r.i, r.j): (r["order"], r.steps) for r in terrain.strahler(spark.createDataFrame([(i, j, v) for (i, j), v in values.items()], "i long, j long, value double")).collect()}
    assert got == {(0, 4): (1, 4), (1, 3): (1, 3), (4, 4): (1, 4), (3, 3): (1, 3), (2, 2): (2, 2), (2, 1): (2, 1), (2, 0): (2, 0)}
