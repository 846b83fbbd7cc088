import math
import random

from latticeworks.operators.regions import area2, exact, noded, overlay, rounded, stroke, union, winding


def box(x0, y0, x1, y1):
    return [exact([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


def star(rng, n, cx, cy):
    angles = sorted(rng.sample(range(360), n))
    return [exact([(cx + round(r * math.cos(math.radians(a))), cy + round(r * math.sin(math.radians(a)))) for a, r in ((a, rng.randrange(30, 100)) for a in angles)])]


def test_areas_add_up():
    rng = random.Random(3)
    for k in range(60):
        a, b = star(rng, 12, 0, 0), star(rng, 12, rng.randrange(-60, 60), rng.randrange(-60, 60))
        if area2(a) <= 0 or area2(b) <= 0 or any(len({*r}) < len(r) for r in (*a, *b)):
            continue
        both, either, less = (area2(overlay(a, b, h)) for h in ("and", "or", "minus"))
        assert both + either == area2(a) + area2(b) and less == area2(a) - both and 0 <= both <= min(area2(a), area2(b))


def test_boxes_that_touch_and_share_edges():
    a = box(0, 0, 4, 4)
    for b, both in ((box(2, 2, 6, 6), 8), (box(4, 0, 8, 4), 0), (box(4, 4, 6, 6), 0), (box(0, 0, 2, 2), 8), (box(1, 1, 3, 3), 8), (box(0, 0, 4, 4), 32), (box(9, 9, 10, 10), 0), (box(2, 0, 6, 4), 16)):
        assert area2(overlay(a, b, "and")) == both
        assert area2(overlay(a, b, "or")) == 32 + area2(b) - both
        assert area2(overlay(a, b, "minus")) == 32 - both
    assert len(overlay(a, box(4, 0, 8, 4), "or")) == 1 and len(overlay(a, box(4, 4, 6, 6), "or")) == 2
    hole = overlay(a, box(1, 1, 3, 3), "minus")
    assert sorted(area2([r]) > 0 for r in hole) == [False, True]
    assert overlay(hole, box(1, 1, 3, 3), "or") == [exact([(0, 0), (4, 0), (4, 4), (0, 4)])]


def test_membership_against_points():
    rng = random.Random(8)
    a, b = star(rng, 14, 0, 0), star(rng, 14, 25, 10)
    got = {h: [e for r in overlay(a, b, h) for e in zip(r, r[1:] + r[:1])] for h in ("and", "or", "minus")}
    inside = lambda p, rings: winding(p, [e for r in rings for e in zip(r, r[1:] + r[:1])])
    for _ in range(400):
        p = exact([(rng.randrange(-110, 140), rng.randrange(-110, 120))])[0]
        u, v = inside(p, a), inside(p, b)
        if u is None or v is None:
            continue
        for h, want in (("and", u and v), ("or", u or v), ("minus", u and not v)):
            w = winding(p, got[h])
            assert w is not None and bool(w) == bool(want)


def test_union_of_many_and_strokes():
    assert area2(union([box(k, 0, k + 2, 2) for k in range(6)])) == 28
    ring = stroke([(0, 0), (1000, 0), (1000, 1000)], 100, 32)
    assert abs(area2(ring) / 2 - (2 * 1000 * 200 + math.pi * 100**2 - 100 * 100 * (1 - math.pi / 4))) < 2000
    assert all(isinstance(v, int) for r in rounded(ring) for p in r for v in p)
    loop = stroke([(0, 0), (900, 0), (900, 900), (0, 900), (0, 0)], 50)
    assert len(loop) == 2 and sorted(area2([r]) > 0 for r in loop) == [False, True]


def test_noding_cuts_where_lines_meet():
    a, b, c = (exact([p])[0] for p in ((0, 0), (4, 0), (2, 2)))
    cross = (c, exact([(2, -2)])[0])
    assert len(noded([(a, b), cross])) == 4 and len(noded([(a, b), (exact([(1, 0)])[0], exact([(9, 0)])[0])])) == 4


def test_networks_in_arrays_are_those_in_rationals():
    import random

    import numpy as np

    from latticeworks.operators.regions import area2, network, noded
    from latticeworks.operators.shapes import faces

    rng = random.Random(8)
    for size in (4, 9, 60, 200_000):
        for n in (1, 2, 5, 14, 30):
            ends = [tuple(rng.randrange(size) for _ in range(4)) for _ in range(n)]
            cut = noded([((a, b), (c, d)) for a, b, c, d in ends if (a, b) != (c, d)])
            areas = faces(cut)
            got = network(np.array(ends, np.int64))
            assert got[:3] == (len({p for e in cut for p in e}), len({tuple(sorted(e)) for e in cut}), len(areas))
            assert abs(got[3] - float(sum(area2([r]) for r in areas))) < 0.01
    assert network(np.empty((0, 4), np.int64)) == (0, 0, 0, 0.0)


def test_strokes_in_arrays_are_those_in_rationals(monkeypatch):
    import numpy as np

    from latticeworks.operators import regions

    one_by_one = []
    monkeypatch.setattr(regions, "stroke", lambda *a: one_by_one.append(a) or stroke(*a))
    rng = random.Random(5)
    square = [(0, 0), (900, 0), (900, 900), (0, 900), (0, 0)]
    odd = [square, square[:2] * 3, [(5, 5)], [], [(1, 1), (1, 1)], [(0, 0), (900, 0), (400, 0)], [(0, 0), (1 << 30, 5)]]
    for size, width, step, at_once in ((10, 3, 1, 7), (6, 50, 100, 64), (2000, 300, 1, 1 << 15), (256_000, 2000, 1, 1 << 15)):
        paths = odd + [[(rng.randrange(size) * step, rng.randrange(size) * step) for _ in range(rng.randrange(8))] for _ in range(60)]
        one_by_one.clear()
        points, at = np.array([p for own in paths for p in own], np.int64), np.append(0, np.cumsum([len(own) for own in paths]))
        rings, area = regions.stroke_measures(points, at, width, together=at_once)
        found = [stroke(own, width) for own in paths]
        assert rings.tolist() == [len(f) for f in found] and area.tolist() == [round(area2(f)) for f in found]
        assert len(one_by_one) < len(paths) // 2 and max(rings) > 1
    assert [a.tolist() for a in regions.stroke_measures(np.empty((0, 2), np.int64), np.zeros(1, np.int64), 50)] == [[], []]
