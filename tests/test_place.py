import math

from pyspark.sql import functions as F

from latticeworks.functions.draws import draw_words, stream
from latticeworks.operators import place, spatial


def word(seed, name, purpose, *keys):
    return int(draw_words(stream(seed, ["rule", name, purpose]), *([k] for k in keys))[0])


def unit(w):
    return (w >> 11) * 2.0**-53


def test_scatter_by_hand(spark):
    """Whole-number arithmetic of any size gives the same instances."""
    s = place.Scatter("trees", 700, (("oak", 2_000_000), (("b", "a", "c"), 1_000_000)), jitter=800_000, scale=(0.5, 1.5), members=(0, 2), radius=300, shrink=0.25, world_seed=9)
    box, want = (-1500, -900, 1500, 900), {}
    for i in range(-1500 // 700, 1500 // 700 + 1):
        for j in range(-900 // 700, 900 // 700 + 1):
            draw = lambda p, *m: word(9, "trees", p, i, j, *m)  # noqa: B023, E731
            w = 700 * 800_000 // 1_000_000
            x, y = i * 700 + (700 - w) // 2 + (draw("jitter_x") * w >> 64), j * 700 + (700 - w) // 2 + (draw("jitter_y") * w >> 64)
            inside = lambda x, y: box[0] <= x <= box[2] and box[1] <= y <= box[3]
            out = 0.5 if x > 0 else 0.0
            if not inside(x, y) or unit(draw("keep")) >= 0.9 * (1 - out):
                continue
            target = draw("asset") * 3_000_000 >> 64
            asset = "oak" if target < 2_000_000 else "abc"[(target - 2_000_000) * 3 // 1_000_000]
            name = f"s700_{f'n{-i}' if i < 0 else i}_{f'n{-j}' if j < 0 else j}"
            want[name] = (asset, x, y, draw("face") * 360_000 >> 64, 0.5 + unit(draw("scale")))
            for m in range(draw("clump_count") * 3 >> 64):
                r, a = 300 * math.sqrt(unit(draw("member_r", m))), draw("member_a", m) * 360_000 >> 64
                mx, my = x + round(r * math.sin(math.radians(a / 1000))), y + round(r * math.cos(math.radians(a / 1000)))
                if inside(mx, my) and unit(draw("member_keep", m)) < 1 - (0.5 if mx > 0 else 0.0):
                    want[f"{name}_m{m}"] = (asset, mx, my, draw("member_face", m) * 360_000 >> 64, (0.5 + unit(draw("member_scale", m))) * 0.75)
    got = place.scatter(spark, s, box, F.lit(0.9), F.when(F.col("x_mm") > 0, 0.5).otherwise(0.0)).collect()
    assert {r.key: (r.asset, r.x_mm, r.y_mm, r.face, r.scale) for r in got} == want and len(got) == len(want) > 8


def test_lowering_a_density_only_removes(spark):
    s = place.Scatter("grass", 500, (("tuft", 1),))
    names = lambda d: {(r.key, r.x_mm, r.y_mm, r.face) for r in place.scatter(spark, s, (0, 0, 9000, 9000), F.lit(d)).collect()}
    assert names(0.3) < names(0.8) < names(1.0)


def a_line(spark):
    return spatial.segments(spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1000, 0), (1, 2, 1000, 500)], "path long, seq long, x_mm long, y_mm long"), "path", "seq")


def test_runs(spark):
    at = lambda **how: [(r.s, r.x_mm, r.y_mm, r.face) for r in place.run_members(a_line(spark), "path", **how).orderBy("k").collect()]
    assert at(count=3) == [(250, 250, 0, 90_000), (750, 750, 0, 90_000), (1250, 1000, 250, 0)]
    assert at(count=2, ends="both") == [(0, 0, 0, 90_000), (1500, 1000, 500, 0)]
    assert [s for s, *_ in at(spacing=400, ends="both")] == [0, 375, 750, 1125, 1500]
    assert at(count=1, span=(0.0, 0.5), offset=100) == [(375, 375, 100, 90_000)]


def test_smooth_keeps_written_points():
    points = [(0, 0), (4000, 1000), (5000, 6000), (9000, 6000)]
    curve = place.smooth(points)
    assert [p for p in curve if p in points] == points and len(curve) > 40
    assert all(math.dist(a, b) < 400 for a, b in zip(curve, curve[1:]))
    assert place.smooth(points[:2]) == points[:2] and place.smooth([points[0], *points]) == curve
    assert place.smooth([(0, 0), (1000, 0), (2000, 0)]) == [(x, 0) for x in range(0, 2001, 250)]


def test_cells_and_followed_paths(spark):
    line = spatial.segments(spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1000, 0)], "path long, seq long, x_mm long, y_mm long"), "path", "seq")
    got = {r.k: (r.frontage, [(p.x, p.y) for p in r.ring]) for r in place.cells(line, "path", 400, 200).collect()}
    assert got == {0: (333, [(0, 0), (333, 0), (333, 200), (0, 200)]), 1: (333, [(333, 0), (666, 0), (666, 200), (333, 200)]), 2: (334, [(666, 0), (1000, 0), (1000, 200), (666, 200)])}
    beside = [(r.n, r.x_mm, r.y_mm) for r in place.follow(line, "path", 500, -100).orderBy("n").collect()]
    assert beside == [(0, 0, -100), (1, 500, -100), (2, 1000, -100)]
