"""Regions as rings of lattice points: noding, union, intersection, difference and strokes, in exact rationals.

A region is a list of rings with its inside on their left: shells run counter-clockwise, holes clockwise. Edges are cut where they
meet other edges, each part is kept or not by where its middle lies, and parts that are kept are joined to rings again. Nothing is
rounded before the end, so areas obey |A or B| + |A and B| = |A| + |B| to the last digit.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..storage import spread

#: Whole numbers stay such, which is much faster; only points where edges cross are fractions.
Number = int | Fraction
Point = tuple[Number, Number]
Edge = tuple[Point, Point]
Ring = list[Point]


def _cross(a: Point, b: Point, c: Point) -> Number:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def exact(ring: list[tuple[int, int]]) -> Ring:
    return [(int(x), int(y)) for x, y in ring]


def area2(rings: list[Ring]) -> Fraction:
    """Twice the area."""
    return sum((a[0] * b[1] - b[0] * a[1] for r in rings for a, b in zip(r, r[1:] + r[:1])), Fraction(0))


def edges_of(rings: list[Ring]) -> list[Edge]:
    return [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1]) if a != b]


def _between(a: Point, b: Point, p: Point) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def meets(e: Edge, f: Edge) -> list[Point]:
    """Points of e at which f cuts it: a crossing, an end on it, or the ends of a stretch they share."""
    (a, b), (c, d) = e, f
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return []
    s, t = _cross(c, d, a), _cross(c, d, b)
    if s == t:
        return [p for p in (c, d) if _between(a, b, p)] if s == 0 else []
    u, v = _cross(a, b, c), _cross(a, b, d)
    if (u > 0 and v > 0) or (u < 0 and v < 0) or (s > 0 and t > 0) or (s < 0 and t < 0):
        return []
    if not s:
        return [a]
    if not t:
        return [b]
    k = Fraction(s) / (s - t)
    return [(_plain_number(a[0] + k * (b[0] - a[0])), _plain_number(a[1] + k * (b[1] - a[1])))]


def _plain_number(x: Number) -> Number:
    return x.numerator if x.denominator == 1 else x


def noded(edges: list[Edge], others: list[Edge] | None = None) -> list[Edge]:
    """The edges, cut wherever another (or one of ``others``) meets them."""
    out = []
    for e in edges:
        cuts = {e[0], e[1]}
        for f in edges if others is None else others:
            if f is not e:
                cuts.update(meets(e, f))
        far = (e[1][0] - e[0][0], e[1][1] - e[0][1])
        line = sorted(cuts, key=lambda p: (p[0] - e[0][0]) * far[0] + (p[1] - e[0][1]) * far[1])  # noqa: B023
        out += list(zip(line, line[1:]))
    return out


def winding(p: Point, edges: list[Edge]) -> int | None:
    """How often the edges go round a point; None on one of them."""
    out = 0
    y = p[1]
    for a, b in edges:
        if a[1] > y and b[1] > y or a[1] < y and b[1] < y:
            continue
        side = _cross(a, b, p)
        if side == 0 and _between(a, b, p):
            return None
        if a[1] <= y < b[1] and side > 0:
            out += 1
        elif b[1] <= y < a[1] and side < 0:
            out -= 1
    return out


def joined(edges: list[Edge]) -> list[Ring]:
    """Rings of directed edges: at a point where several go on, the one most to the right of the way back, so that rings that touch stay apart."""
    after: dict[Point, list[Point]] = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    out = []
    while after:
        start = min(after)
        ring, last, here = [], None, start
        while True:
            ways = after[here]
            if len(ways) > 1 and last is not None:
                back = math.atan2(float(last[1] - here[1]), float(last[0] - here[0]))
                to = min(ways, key=lambda q: (back - math.atan2(float(q[1] - here[1]), float(q[0] - here[0]))) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
            else:
                to = ways[0]
            ways.remove(to)
            if not ways:
                del after[here]
            ring.append(here)
            last, here = here, to
            if here == start and (here not in after or len(ring) > 1):
                break
        out.append(_plain(ring))
    return [r for r in out if len(r) > 2]


def _plain(ring: Ring) -> Ring:
    """Without vertices on the straight line between their neighbours, from the least vertex on."""
    kept = [b for a, b, c in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1]) if _cross(a, b, c) != 0]
    if not kept:
        return []
    at = kept.index(min(kept))
    return kept[at:] + kept[:at]


def _middle(e: Edge) -> Point:
    return _half(e[0][0] + e[1][0]), _half(e[0][1] + e[1][1])


def _half(x: Number) -> Number:
    return _plain_number(Fraction(x) / 2) if not isinstance(x, int) or x % 2 else x // 2


def _holds(box: tuple[Number, ...], p: Point) -> bool:
    return box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]


def union(regions: list[list[Ring]]) -> list[Ring]:
    """What any of the regions holds. All are cut by one another at once, so numbers don't grow with their number."""
    own = [edges_of(r) for r in regions]
    boxes = [tuple(f(p[c] for r in x for p in r) for f in (min, max) for c in (0, 1)) if any(x) else (0, 0, -1, -1) for x in regions]
    kept: set[Edge] = set()
    shared: set[Edge] = set()
    for k, mine in enumerate(own):
        others = [f for m, e in enumerate(own) if m != k for f in e]
        for e in noded(mine, others):
            middle = _middle(e)
            places = [winding(middle, o) for m, o in enumerate(own) if m != k and _holds(boxes[m], middle)]
            if all(p is None or p == 0 for p in places):
                (shared if None in places else kept).add(e)
    kept |= {e for e in shared if (e[1], e[0]) not in shared}  # where two lie side by side, nothing is left
    return joined(sorted(kept))


def overlay(a: list[Ring], b: list[Ring], how: str) -> list[Ring]:
    """``and``: what both hold; ``or``: what either holds; ``minus``: what a holds and b doesn't."""
    if how == "or":
        return union([a, b])
    mine, other = edges_of(a), edges_of(b)
    cut_a, cut_b = noded(mine, other), noded(other, mine)
    of_b = set(cut_b)
    kept = set()
    for e in cut_a:
        w = winding(_middle(e), other)
        if w is None:
            if (e in of_b) == (how == "and"):
                kept.add(e)
        elif (w != 0) == (how == "and"):
            kept.add(e)
    for e in cut_b:
        w = winding(_middle(e), mine)
        if w is not None and w != 0:
            kept.add(e if how == "and" else (e[1], e[0]))
    return joined(sorted(kept))


def _dots(width: int, corners: int) -> list[tuple[int, int]]:
    return [(round(width * math.cos(2 * math.pi * (k + 0.5) / corners)), round(width * math.sin(2 * math.pi * (k + 0.5) / corners))) for k in range(corners)]


def _hull(points: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Counter-clockwise, without points on its sides."""
    hull: list[tuple[int, int]] = []
    line = sorted(points)
    for way in (line, line[::-1]):
        side: list[tuple[int, int]] = []
        for p in way:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(p)
        hull += side[:-1]
    return hull


def stroke(path: list[tuple[int, int]], width: int, corners: int = 8) -> list[Ring]:
    """What lies within ``width`` of a path, with ends and joins of so many corners a full turn."""
    dots = _dots(width, corners)
    return union([[exact(_hull({(p[0] + x, p[1] + y) for p in (a, b) for x, y in dots}))] for a, b in zip(path, path[1:])])


#: Fractions of an edge, and places in parts of a millimetre, that are nearer than this aren't told apart in floats; and a path's greatest extent there.
_NEAR, _GRID, _EXTENT = 1e-11, 4096, 1 << 25
#: Paths worked on at once.
_PATHS = 2048


def stroke_measures(points: np.ndarray, at: np.ndarray, width: int, corners: int = 8, together: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Of many paths (path k is points[at[k]:at[k + 1]], whole numbers): the number of rings of its ``stroke``, and twice their area, rounded half to even.

    Which side of an edge a point lies on is told in whole numbers. Each side of the hull of a piece of a path is cut by the other hulls of its path into
    stretches that stay; these are rings, end to start. Where floats can't tell (ends that nearly or wholly meet, rings that touch, areas near a half),
    the path is worked on by ``stroke``. ``together``: pairs of a side and a hull at once.
    """
    n = len(at) - 1
    if n > _PATHS:
        parts = [stroke_measures(points[at[k] : at[min(k + _PATHS, n)]], at[k : k + _PATHS + 1] - at[k], width, corners, together) for k in range(0, n, _PATHS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    doubt, rings, area = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    dots = np.array(_hull(set(_dots(width, corners))), np.int64).reshape(-1, 2)
    many = len(dots) + 2
    own = np.repeat(np.arange(n), np.diff(at))
    first = np.flatnonzero(own[1:] == own[:-1])
    path = own[first]
    if not len(path):
        return rings, area
    some = np.flatnonzero(np.diff(at))
    low, high = (f.reduceat(points, at[some], axis=0) for f in (np.minimum, np.maximum))
    doubt[some] = (high - low).max(axis=1) + 2 * width > _EXTENT
    shift = np.zeros((n, 2), np.int64)
    shift[some] = (low + high) // 2
    doubt |= len(dots) < 3
    wide = doubt[path]
    first, path = first[~wide], path[~wide]
    if len(path):
        a, b = points[first] - shift[path], points[first + 1] - shift[path]
        measured = _strokes(a, b, path, n, dots, many, together)
        doubt |= measured[0]
        rings, area = measured[1:]
    for k in np.flatnonzero(doubt):
        found = stroke([(int(x), int(y)) for x, y in points[at[k] : at[k + 1]]], width, corners)
        rings[k], area[k] = len(found), round(area2(found))
    return rings, area


def _strokes(a: np.ndarray, b: np.ndarray, path: np.ndarray, n: int, dots: np.ndarray, many: int, together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces a to b of paths, in order of these: which paths are in doubt, rings, and areas."""
    doubt = np.zeros(n, bool)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    # Hulls: the sides of the ring of dots that look ahead lie at b, the others at a, and between them are two sides from end to end.
    way, side = (b - a)[:, None], np.roll(dots, -1, axis=0) - dots
    ahead, along = cross(way, side), (way * side).sum(axis=2)
    begins, ends = (ahead > 0) | ((ahead == 0) & (along < 0)), (ahead > 0) | ((ahead == 0) & (along > 0))  # at b, not at a
    before = np.roll(ends, 1, axis=1)
    there = np.stack([np.ones_like(begins), begins != before], axis=2).reshape(len(a), -1)
    at_b = np.stack([before, begins], axis=2).reshape(len(a), -1)
    corner = a[:, None] + np.repeat(dots, 2, axis=0) + at_b[..., None] * way
    size = there.sum(axis=1)
    head = np.append(0, np.cumsum(size))
    p, hull = corner[there], np.repeat(np.arange(len(a)), size)
    q = np.roll(p, -1, axis=0)
    q[head[1:] - 1] = p[head[:-1]]
    d, of = q - p, path[hull]
    # Every hull's sides as a row of the same length, the last one repeated.
    slot = head[:-1, None] + np.minimum(np.arange(many), size[:, None] - 1)
    # Whole numbers under 2 ** 53, which floats hold and multiply faster: over 0 is inside.
    dx, dy, base = d[slot, 0].astype(float), d[slot, 1].astype(float), cross(d, p)[slot].astype(float)
    px, py = p.T.astype(float)
    follow = np.arange(1, len(p) + 1)
    follow[head[1:] - 1] = head[:-1]
    least, most = (f(p, q).T.copy() for f in (np.minimum, np.maximum))
    box_low, box_high = np.minimum.reduceat(least, head[:-1], axis=1), np.maximum.reduceat(most, head[:-1], axis=1)

    start = np.searchsorted(path, np.arange(n + 1))
    others = (start[1:] - start[:-1])[of]
    done = np.append(0, np.cumsum(others))
    cut: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(p):  # some sides, against all hulls of their paths
        hi = max(int(np.searchsorted(done, done[lo] + together, side="right")) - 1, lo + 1)
        e = np.repeat(np.arange(lo, hi), others[lo:hi])
        h = start[of[e]] + np.arange(len(e)) - (done[e] - done[lo])
        lo = hi
        ok = h != hull[e]
        for c in (0, 1):
            e, h = e[ok], h[ok]
            ok = (least[c][e] <= box_high[c][h]) & (box_low[c][h] <= most[c][e])
        e, h = e[ok], h[ok]
        fx, fy, f0, far = dx[h], dy[h], base[h], follow[e]
        s = fx * py[e, None]
        s -= fy * px[e, None]
        s -= f0
        fx *= py[far, None]
        fy *= px[far, None]
        t = fx - fy - f0
        outside = (s <= 0) & (t <= 0)
        i = np.flatnonzero(~outside.any(axis=1))
        x, y = s[i], t[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            cutting = x / (x - y)
        enter = np.where((x <= 0) & (y > 0), cutting, 0).max(axis=1, initial=0)
        leave = np.where((y <= 0) & (x > 0), cutting, 1).min(axis=1, initial=1)
        doubt[of[e[i[np.abs(enter - leave) < _NEAR]]]] = True
        go = enter < leave
        cut.append((e[i[go]], np.abs(enter[go]), leave[go]))
        i, k = np.nonzero(outside & (s == 0) & (t == 0))  # side by side: none stays if they look different ways, else that of the first hull
        e, h, f = e[i], h[i], slot[h[i], k]
        fp, fd = p[f], d[f]
        size2 = (d[e] * d[e]).sum(axis=1)
        one, two = (np.clip(((x - p[e]) * d[e]).sum(axis=1) / size2, 0, 1) for x in (fp, fp + fd))
        against = (fd * d[e]).sum(axis=1) < 0
        go = (one != two) & (against | (h < hull[e]))
        cut.append((e[go], np.minimum(one, two)[go], np.maximum(one, two)[go]))

    e, enter, leave = (np.concatenate(c) for c in zip(*cut))
    order = np.lexsort((leave, enter, e))
    e, enter, leave = e[order], enter[order], leave[order]
    rank = np.arange(len(e)) - np.searchsorted(e, e)
    so_far = np.zeros(len(p))
    stays: list[tuple[np.ndarray, ...]] = []
    by_rank = np.argsort(rank, kind="stable")
    upto = np.append(0, np.cumsum(np.bincount(rank)))
    for j in range(len(upto) - 1):  # the next stretch of every side that goes
        i = by_rank[upto[j] : upto[j + 1]]
        was = so_far[e[i]]
        doubt[of[e[i[(np.abs(enter[i] - was) < _NEAR) & (enter[i] > 0)]]]] = True
        gap = enter[i] > was
        stays.append((e[i[gap]], was[gap], enter[i[gap]]))
        so_far[e[i]] = np.maximum(was, leave[i])
    doubt[of[(so_far < 1) & (so_far > 1 - _NEAR)]] = True
    rest = np.flatnonzero(so_far < 1)
    stays.append((rest, so_far[rest], np.ones(len(rest))))
    e, t0, t1 = (np.concatenate(c) for c in zip(*stays))
    order = np.argsort(e, kind="stable")
    e, t0, t1 = e[order], t0[order], t1[order]

    keys = []
    for t in (t0, t1):
        key = of[e].astype(np.uint64)
        for c, by in ((0, 0xC2B2AE3D27D4EB4F), (1, 0x165667B19E3779F9)):
            spot = (p[e, c] + t * d[e, c]) * _GRID
            cell = np.rint(spot)
            doubt[of[e[np.abs(np.abs(spot - cell) - 0.5) < 1e-4]]] = True
            key = (key * np.uint64(0x9E3779B97F4A7C15) + cell.astype(np.int64).view(np.uint64)) * np.uint64(by)
            key ^= key >> np.uint64(29)
        keys.append(key)
    order = np.argsort(keys[0], kind="stable")
    starts = keys[0][order]
    where = np.minimum(np.searchsorted(starts, keys[1]), len(starts) - 1)
    after = order[where]
    twice = np.flatnonzero(starts[1:] == starts[:-1])
    doubt[of[e[order[np.concatenate([twice, twice + 1])]]]] = True
    doubt[of[e[(starts[where] != keys[1]) | (of[e[after]] != of[e])]]] = True
    doubt[of[e[np.bincount(after, minlength=len(e)) != 1]]] = True
    after = np.where(doubt[of[e]], np.arange(len(e)), after)
    label = np.arange(len(e))
    for _ in range(int(np.bincount(of[e], minlength=1).max()).bit_length()):  # the least stretch of each ring, by jumps of doubling length
        label, after = np.minimum(label, label[after]), after[after]
    rings = np.bincount(of[e[label == np.arange(len(e))]], minlength=n)

    whole, turn = (t0 == 0) & (t1 == 1), cross(p[e], q[e])
    total, unsure = np.zeros(n, np.longdouble), np.full(n, 1e-9)
    for some, length in ((whole, turn), (~whole, (t1 - t0).astype(np.longdouble) * turn)):
        into = of[e[some]]
        if len(into):
            begin = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            total[into[begin]] += np.add.reduceat(length[some], begin)
    unsure += np.bincount(of[e[~whole]], np.abs(turn[~whole]), n) * 5e-16  # fractions of sides are rounded to 53 bits
    doubt |= np.abs(total - np.floor(total) - 0.5) < unsure
    return doubt, rings, np.rint(total).astype(np.int64)


def _cut(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which edge (ends: ax, ay, bx, by, whole numbers of 18 bits), and the points where it is cut, its ends among them, as reduced (X, Y, D) for (X / D, Y / D)."""
    n = len(ends)
    a, b = ends[:, :2], ends[:, 2:]
    cross = lambda p, q, r: (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
    own, other = np.triu_indices(n, 1)
    near = np.ones(len(own), bool)
    for c in (0, 1):
        low, high = np.minimum(a[:, c], b[:, c]), np.maximum(a[:, c], b[:, c])
        near &= (low[own] <= high[other]) & (low[other] <= high[own])
    e, f = own[near], other[near]
    s, t, u, v = cross(a[f], b[f], a[e]), cross(a[f], b[f], b[e]), cross(a[e], b[e], a[f]), cross(a[e], b[e], b[f])
    flat = (s == 0) & (t == 0)
    hit = ~flat & (np.sign(s) * np.sign(t) <= 0) & (np.sign(u) * np.sign(v) <= 0)
    d = (s - t)[hit]
    sign = np.sign(d)
    point = np.column_stack([a[e[hit]] * d[:, None] + s[hit, None] * (b - a)[e[hit]], d]) * sign[:, None]
    point //= np.gcd.reduce(point, axis=1)[:, None]
    whole = lambda p: np.column_stack([p, np.ones(len(p), np.int64)])
    edge, cut = [np.arange(n), np.arange(n), e[hit], f[hit]], [whole(a), whole(b), point, point]
    for one, two in ((e[flat], f[flat]), (f[flat], e[flat])):  # on one line: the ends of one that lie on the other
        for p in (a[two], b[two]):
            on = ((np.minimum(a[one], b[one]) <= p) & (p <= np.maximum(a[one], b[one]))).all(axis=1)
            edge.append(one[on])
            cut.append(whole(p[on]))
    return np.concatenate(edge), np.concatenate(cut)


def network(ends: np.ndarray) -> tuple[int, int, int, float]:
    """Of edges (rows of ax, ay, bx, by) cut where they meet: junctions, edges, bounded areas, and twice what these hold. The same as of ``noded`` and
    ``shapes.faces``, in arrays of whole numbers; only the measure is a float."""
    ends = ends[(ends[:, :2] != ends[:, 2:]).any(axis=1)]
    if not len(ends):
        return 0, 0, 0, 0.0
    ends = ends - np.tile(ends.reshape(-1, 2).min(axis=0), 2)
    edge, cut = _cut(ends)
    points, at = np.unique(cut, axis=0, return_inverse=True)
    at = at.ravel()
    xy = points[:, :2] / points[:, 2:]
    way = (ends[:, 2:] - ends[:, :2])[edge]
    along = ((xy[at] - ends[edge, :2]) * way).sum(axis=1)
    order = np.lexsort((at, along, edge))
    edge, at, way = edge[order], at[order], way[order]
    p, q, way = at[:-1], at[1:], way[1:]
    real = (edge[1:] == edge[:-1]) & (p != q)
    p, q, way = p[real], q[real], way[real]
    _, first = np.unique(np.minimum(p, q) * len(points) + np.maximum(p, q), return_index=True)
    p, q, way = p[first], q[first], way[first]
    m = len(p)
    start, end = np.append(p, q), np.append(q, p)
    angle = np.arctan2(*np.append(way, -way, axis=0).T[::-1].astype(float))
    order = np.lexsort((angle, start))
    place = np.empty(2 * m, np.int64)
    place[order] = np.arange(2 * m)
    head = np.searchsorted(start[order], np.arange(len(points) + 1))
    back = place[np.append(np.arange(m, 2 * m), np.arange(m))]  # where the way back stands around the end
    before = order[np.where(back == head[end], head[end + 1] - 1, back - 1)]  # the next edge clockwise
    label, jump = np.arange(2 * m), before
    for _ in range((2 * m).bit_length()):  # the least edge of each cycle, by jumps of doubling length
        label, jump = np.minimum(label, label[jump]), jump[jump]
    area = np.bincount(label, xy[start, 0] * xy[end, 1] - xy[end, 0] * xy[start, 1], 2 * m)
    twin = np.append(label[m:], label[:m])
    inside = np.bincount(label[label != twin], minlength=2 * m) > 0  # else only there and back again
    for k in np.flatnonzero(inside & (np.abs(area) < 1)):  # too small to trust a float's sign
        spot = lambda h: [Fraction(int(points[h, c]), int(points[h, 2])) for c in (0, 1)]
        area[k] = sum(a[0] * b[1] - b[0] * a[1] for a, b in ((spot(start[h]), spot(end[h])) for h in np.flatnonzero(label == k)))
    inside &= area > 0
    return len(points), m, int(inside.sum()), float(area[inside].sum())


def rounded(rings: list[Ring]) -> list[list[tuple[int, int]]]:
    """On the lattice, half to even; rings that shrink to nothing go."""
    out = []
    for r in rings:
        kept: list[tuple[int, int]] = []
        for x, y in r:
            p = (round(x), round(y))
            if not kept or p != kept[-1]:
                kept.append(p)
        if len(kept) > 1 and kept[0] == kept[-1]:
            kept.pop()
        if len(kept) > 2:
            out.append(kept)
    return out


def overlay_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (one, two, ring_one, ring_two) with twice the areas that both, either, and the first alone hold, rounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for one, two, p, q in zip(batch["one"], batch["two"], batch["ring_one"], batch["ring_two"]):
                a, b = ([exact([(int(v["x"]), int(v["y"])) for v in r])] for r in (p, q))
                rows.append((one, two, *(round(area2(overlay(a, b, how))) for how in ("and", "or", "minus"))))
            yield pd.DataFrame(rows, columns=["one", "two", "both2", "either2", "alone2"])

    return spread(pairs.select("one", "two", "ring_one", "ring_two")).mapInPandas(run, "one string, two string, both2 long, either2 long, alone2 long")
