"""Queries without a SQL twin work on all rows of their tables."""

import heapq
import math
import random

import pytest

from latticeworks.plans import catalogue, places

FAR = 150_000


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    """Some paths, and the same again under ids far from theirs."""
    path, rng = tmp_path_factory.mktemp("paths"), random.Random(3)
    rows = [(p, k, rng.randrange(1, 2000), rng.randrange(1, 100)) for p in range(1, 6) for k in range(1, 5)]
    both = rows + [(p + FAR, k, x, y) for p, k, x, y in rows]
    spark.createDataFrame(both, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["street_strokes", "network_areas", "frontage_cells", "followed_paths", "run_members", "smooth_paths"])
def test_far_paths_are_as_near_ones(spark, paths, name):
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, paths).collect()]
    shift = FAR // 20 if name == "network_areas" else FAR  # the first column is a path, or a town of 20
    near = sorted(r for r in got if r[0] < shift)
    assert near and sorted((r[0] - shift, *r[1:]) for r in got if r[0] >= shift) == near


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A strip of 5 by 43 posts, beyond the 40 rows that SQL reads, and part 0 away from it."""
    path = tmp_path_factory.mktemp("parts")
    spark.createDataFrame([(40 * j + i + 1,) for i in range(5) for j in range(43)] + [(0,)], "p_partkey long").write.parquet(f"{path}/part.parquet")
    return str(path)


def heights():
    return {(i, j): float((40 * j + i + 1) * 7919 % 997) for i in range(5) for j in range(43)} | {(39, -1): 0.0}


def around(p, z):
    return [q for x in (-1, 0, 1) for y in (-1, 0, 1) if (x or y) and (q := (p[0] + x, p[1] + y)) in z]


def test_ways_over_all_posts(spark, parts):
    z, cost, todo = heights(), {}, [(0.0, (0, 0))]
    while todo:
        c, p = heapq.heappop(todo)
        if p not in cost:
            cost[p] = c
            for q in around(p, z):
                heapq.heappush(todo, (c + (z[p] + z[q]) / 2 * (math.sqrt(2) if p[0] != q[0] and p[1] != q[1] else 1), q))
    got = {(r.i, r.j): r.cost for r in catalogue.QUERIES["least_cost"](spark, parts).collect()}
    assert got == pytest.approx(cost | {(39, -1): math.inf}, abs=1e-5)


def test_flows_over_all_posts(spark, parts):
    z = heights()
    count = dict.fromkeys(z, 1)
    for p in sorted(z, key=z.get, reverse=True):
        lower = [((z[q] - z[p]) / (math.sqrt(2) if p[0] != q[0] and p[1] != q[1] else 1), q[1], q[0]) for q in around(p, z) if z[q] < z[p]]
        if lower:
            _, j, i = min(lower)
            count[i, j] += count[p]
    assert {(r.i, r.j): r.n for r in catalogue.QUERIES["flow_accumulation"](spark, parts).collect()} == count


@pytest.mark.parametrize("name", ["eroded_land", "stream_orders", "settled_slopes"])
def test_land_over_all_posts(spark, parts, name):
    got = [(r.i, r.j) for r in catalogue.QUERIES[name](spark, parts).collect()]
    assert len(got) == len(set(got)) and set(got) == set(heights())


def test_outlines_of_all_zones(spark, parts):
    got = {r.zone for r in catalogue.QUERIES["mask_regions"](spark, parts).collect()}
    assert got == {j // 8 for (_, j), v in heights().items() if v > 600}


def spilled(z):
    """By Priority-Flood: posts in the order of the lowest way to the rim."""
    todo = [(v, p) for p, v in z.items() if len(around(p, z)) < 8]
    heapq.heapify(todo)
    out = {}
    while todo:
        v, p = heapq.heappop(todo)
        if p not in out:
            out[p] = v
            for q in around(p, z):
                heapq.heappush(todo, (max(v, z[q]), q))
    return out


@pytest.fixture(scope="module")
def land(spark, tmp_path_factory):
    """41 whole rows of 40 posts and a short one."""
    path = tmp_path_factory.mktemp("land")
    spark.range(1, 1660).withColumnRenamed("id", "p_partkey").write.parquet(f"{path}/part.parquet")
    return str(path), {((k - 1) % 40, (k - 1) // 40): float(k * 7919 % 997) for k in range(1, 1660)}


def test_fills_over_all_posts(spark, land):
    path, z = land
    filled = spilled(z)
    assert {(r.i, r.j): r.filled for r in catalogue.QUERIES["flood_fill"](spark, path).collect()} == filled
    assert any(filled[p] > z[p] for p in z)
    assert {(r.i, r.j): r.value for r in catalogue.QUERIES["shallow_filled"](spark, path).collect()} == {p: filled[p] if filled[p] - z[p] < 60 else z[p] for p in z}


@pytest.mark.parametrize("side", [7, 16, 256])
def test_tiles_make_no_difference(spark, land, side):
    from pyspark.sql import functions as F

    from latticeworks.operators import raster
    from latticeworks.plans.views import field

    path, z = land
    f = raster.with_rim(field(spark, path))
    assert {(r.i, r.j): r.filled for r in raster.fill(f, F.col("rim"), side).collect()} == spilled(z)
    cost, todo = {}, [(0.0, (3, 4))]
    while todo:
        c, p = heapq.heappop(todo)
        if p not in cost:
            cost[p] = c
            for q in around(p, z):
                heapq.heappush(todo, (c + (z[p] + z[q]) / 2 * math.hypot(p[0] - q[0], p[1] - q[1]), q))
    got = {(r.i, r.j): r.cost for r in raster.least_cost(f, (F.col("i") == 3) & (F.col("j") == 4), side).collect()}
    assert got == pytest.approx(cost)
    assert raster.fill(f.limit(0), F.col("rim"), side).count() == 0


def test_fill_drains(spark, land):
    path, z = land
    todo = [(v, p) for p, v in z.items() if len(around(p, z)) < 8]
    heapq.heapify(todo)
    want = {}
    while todo:
        v, p = heapq.heappop(todo)
        if p not in want:
            want[p] = v
            for q in around(p, z):
                heapq.heappush(todo, (max(v + 0.25, z[q]), q))
    assert {(r.i, r.j): r.filled for r in catalogue.QUERIES["flood_epsilon"](spark, path).collect()} == want


def test_discharge_over_all_posts(spark, parts):
    z = heights()
    sums = {p: int(p[0] + z[p]) for p in z}
    for p in sorted(z, key=z.get, reverse=True):
        lower = [((z[q] - z[p]) / (math.sqrt(2) if p[0] != q[0] and p[1] != q[1] else 1), q[1], q[0]) for q in around(p, z) if z[q] < z[p]]
        if lower:
            _, j, i = min(lower)
            sums[i, j] += sums[p]
    assert {(r.i, r.j): r.n for r in catalogue.QUERIES["discharge"](spark, parts).collect()} == sums


def test_courses_are_cheapest_ways(spark, land):
    """What is on the ways is joined up from the corner to each target, at the cost that Dijkstra gives."""
    path, z = land
    cost, todo = {}, [(0.0, (0, 0))]
    while todo:
        c, p = heapq.heappop(todo)
        if p not in cost:
            cost[p] = c
            for q in around(p, z):
                heapq.heappush(todo, (c + (z[p] + z[q]) / 2 * math.hypot(p[0] - q[0], p[1] - q[1]), q))
    got = {(r.i, r.j): r.cost for r in catalogue.QUERIES["route_course"](spark, path).collect()}
    targets = {p for p in z if p[0] == 39 and p[1] % 10 == 9}
    assert targets <= set(got) and (0, 0) in got and all(got[p] == pytest.approx(cost[p], abs=1e-5) for p in got)
    for p in got:
        steps = [q for q in around(p, z) if q in got and abs(cost[q] + (z[p] + z[q]) / 2 * math.hypot(p[0] - q[0], p[1] - q[1]) - cost[p]) < 1e-6]
        assert p == (0, 0) or steps
    on = set(targets)
    while more := {q for p in on for q in around(p, z) if q in got and abs(cost[q] + (z[p] + z[q]) / 2 * math.hypot(p[0] - q[0], p[1] - q[1]) - cost[p]) < 1e-6} - on:
        on |= more
    assert set(got) <= on


def test_members_of_a_clump_in_order(spark, data):
    from latticeworks.plans.views import points

    data = data.replace("sf0.001", "sf0.01")
    rows = [(r.id, r.x_mm, r.y_mm, r.nation) for r in points(spark, data).collect()]
    kept = []
    for r in sorted(rows):
        if all(k[3] != r[3] or (k[1] - r[1]) ** 2 + (k[2] - r[2]) ** 2 > 144_000_000 for k in kept):
            kept.append(r)
    got = {r.id for r in catalogue.QUERIES["clump_order"](spark, data).collect()}
    assert got == {r[0] for r in kept} and len(got) < len(rows)


def test_cause_chains_are_those_of_breadth_first_search(spark, data):
    """On the query's own table: of the shortest chains from each changed part, the least."""
    to = {}
    for r in places._edges(spark, data).collect():
        to.setdefault(r.a, []).append(r.b)
    want = {}
    for start in (r[0] for r in spark.read.parquet(f"{data}/part.parquet").where("p_size = 7").select("p_partkey").collect()):
        front = {start: (start,)}
        while front:
            want |= {(node, start): chain for node, chain in front.items()}
            after = {}
            for chain in sorted(front.values()):
                for b in to.get(chain[-1], ()):
                    if (b, start) not in want and b not in after:
                        after[b] = (*chain, b)
            front = after
    got = {(r.node, r.cause): r.chain for r in places.cause_chains(spark, data).collect()}
    assert len(got) > 10 and got == {k: " > ".join(map(str, c)) for k, c in want.items()}


def test_rounds_are_gathered_without_loss(spark):
    """Ways longer than the tables that are read as one."""
    from latticeworks.operators import graph

    line = spark.range(25).selectExpr("id as a", "id + 1 as b")
    start = spark.createDataFrame([(0,), (20,)], "node long")
    assert {(r.node, r.level) for r in graph.levels(line, start.where("node = 0")).collect()} == {(k, k) for k in range(26)}
    assert {(r.node, r.cause): list(r.chain) for r in graph.causes(line, start).collect()} == {(k, c): list(range(c, k + 1)) for c in (0, 20) for k in range(c, 26)}
    ties = spark.range(1, 26).selectExpr("id", "id - 1 as ahead")
    assert {r.id for r in graph.independent(spark.range(26).toDF("id"), ties).collect()} == set(range(0, 26, 2))
