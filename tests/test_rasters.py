import heapq
import math
import random

from latticeworks.operators import graph, raster, relational, spatial


def a_field(spark, nx=9, ny=7, seed=1):
    rng = random.Random(seed)
    values = {(i, j): float(rng.randrange(50)) for i in range(nx) for j in range(ny)}
    return values, spark.createDataFrame([(i, j, v) for (i, j), v in values.items()], "i long, j long, value double")


def around(i, j, values):
    return [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (i + a, j + b) in values]


def test_fill_is_a_priority_flood(spark):
    values, df = a_field(spark)
    rim = {p for p in values if p[0] in (0, 8) or p[1] in (0, 6)}
    done, heap = {}, [(values[p], p) for p in rim]
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        if p not in done:
            done[p] = v
            for q in around(*p, values):
                heapq.heappush(heap, (max(v, values[q]), q))
    got = {(r.i, r.j): r.filled for r in raster.fill(df, (df.i.isin(0, 8)) | (df.j.isin(0, 6))).collect()}
    assert got == done


def test_least_cost_is_dijkstra(spark):
    values, df = a_field(spark, seed=2)
    done, heap = {}, [(0.0, (0, 0))]
    while heap:
        c, p = heapq.heappop(heap)
        if p not in done:
            done[p] = c
            for q in around(*p, values):
                heapq.heappush(heap, (c + (values[p] + values[q]) / 2 * (math.sqrt(2) if p[0] != q[0] and p[1] != q[1] else 1), q))
    got = {(r.i, r.j): r.cost for r in raster.least_cost(df, (df.i == 0) & (df.j == 0)).collect()}
    assert got.keys() == done.keys() and all(abs(got[p] - done[p]) < 1e-9 for p in done)


def test_accumulation_counts_posts_upstream(spark):
    values, df = a_field(spark, seed=3)
    down = {}
    for p, v in values.items():
        lower = [(-(v - values[q]) / (math.sqrt(2) if p[0] != q[0] and p[1] != q[1] else 1), q[1], q[0]) for q in around(*p, values) if values[q] < v]
        if lower:
            _, j, i = min(lower)
            down[p] = (i, j)
    count = dict.fromkeys(values, 0)
    for p in values:
        while p is not None:
            count[p] += 1
            p = down.get(p)
    got = {(r.i, r.j): r.n for r in raster.accumulate(df).collect()}
    assert got == count


def test_moving_mean_shrinks_at_ends(spark):
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(range(3, 14))], "path long, seq long, v double")
    got = relational.moving_mean(df, "path", "seq", "v", 2).orderBy("seq").first()
    assert got["smooth"] == 4.5


def test_components_and_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)], "a long, b long")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(2, 1), (3, 1), (5, 4)}
    starts = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.levels(edges.na.drop(), starts).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_fixed_sum_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(0, k, rng.random() * 10 ** rng.randrange(-8, 8)) for k in range(3000)]
    sums = {relational.fixed_sum(spark.createDataFrame(rows, "g long, k long, v double").repartition(n), ["g"], "k", "v").first()["total"] for n in (1, 3, 8)}
    chunks = []
    for at in range(0, 3000, 1024):
        total = 0.0
        for _, _, v in rows[at : at + 1024]:
            total += v
        chunks.append(total)
    want = 0.0
    for c in chunks:
        want += c
    assert sums == {want}


def test_nearest_beyond_the_first_tile(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 250_000, 250_000)], "id long, x_mm long, y_mm long")
    sites = spark.createDataFrame([(8, 100, 0), (9, 100, 0), (7, 90_000, 0)], "id long, x_mm long, y_mm long")
    got = {r.id: r.site for r in spatial.nearest(points, sites, 256_000, 1000).collect()}
    assert got == {1: 8, 2: 7}
