"""Plain-Python geometries as rows of the geometry struct, and brute-force distances."""

from __future__ import annotations

import math

Part = tuple[str, list[list[tuple[float, float]]]]


def geom(kind: str, *parts: Part):
    if kind == "POINT":
        (x, y) = parts[0][1][0][0]
        return (kind, float(x), float(y), float(x), float(y), None)
    xs = [x for _, rings in parts for ring in rings for x, _ in ring]
    ys = [y for _, rings in parts for ring in rings for _, y in ring]
    body = [(k, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for k, rings in parts]
    return (kind, float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)), body)


def point(x, y):
    return geom("POINT", ("POINT", [[(x, y)]]))


def line(*xy):
    return geom("LINESTRING", ("LINESTRING", [list(xy)]))


def polygon(*rings):
    return geom("POLYGON", ("POLYGON", [list(r) for r in rings]))


def box(x1, y1, x2, y2):
    return polygon([(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)])


def _segments(g):
    if g[0] == "POINT":
        return [(g[1], g[2], g[1], g[2], False)]
    out = []
    for kind, rings in g[5]:
        for ring in rings:
            if len(ring) == 1:
                (x, y) = ring[0]
                out.append((x, y, x, y, False))
            out += [(*a, *b, kind == "POLYGON") for a, b in zip(ring, ring[1:])]
    return out


def _point_segment(px, py, s):
    x1, y1, x2, y2 = s[:4]
    dx, dy = x2 - x1, y2 - y1
    d2 = dx * dx + dy * dy
    t = 0.0 if d2 == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / d2))
    return math.hypot(x1 + t * dx - px, y1 + t * dy - py)


def _orient(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _segment_distance(s, t):
    a, b, c, d = s[:2], s[2:4], t[:2], t[2:4]
    if (
        _orient(*a, *b, *c) * _orient(*a, *b, *d) < 0
        and _orient(*c, *d, *a) * _orient(*c, *d, *b) < 0
    ):
        return 0.0
    return min(
        _point_segment(*c, s), _point_segment(*d, s), _point_segment(*a, t), _point_segment(*b, t)
    )


def _inside(x, y, segs):
    odd = False
    for x1, y1, x2, y2, areal in segs:
        if areal and (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            odd = not odd
    return odd


def _first_vertices(g):
    return [(g[1], g[2])] if g[0] == "POINT" else [rings[0][0] for _, rings in g[5]]


def distance(a, b) -> float:
    sa, sb = _segments(a), _segments(b)
    if any(_inside(x, y, sa) for x, y in _first_vertices(b)):
        return 0.0
    if any(_inside(x, y, sb) for x, y in _first_vertices(a)):
        return 0.0
    return min(_segment_distance(s, t) for s in sa for t in sb)
