"""Set operations of geometries in the plane: intersection, union, difference and symmetric difference.

All boundaries are cut where they meet. A piece belongs to the result's boundary if
the operation holds on exactly one of its sides; such pieces, directed with the
inside on the left, close to rings. Lines and points that the operation keeps, and
that the areas (then the lines) do not cover, come beside.
"""

from __future__ import annotations

import math

from tessera.functions import geo

OPERATIONS = {"intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "symDifference": lambda a, b: a != b}


def _area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _rings(edges: list) -> list:
    """Simple closed rings of directed edges, the inside always on the left."""
    after: dict = {}
    for p, q in edges:
        after.setdefault(p, []).append(q)
    out = []
    while after:
        start = next(iter(after))
        path, at = [start], {start: 0}
        while True:
            p = path[-1]
            ways = after[p]
            if len(ways) > 1 and len(path) > 1:
                back = math.atan2(path[-2][1] - p[1], path[-2][0] - p[0])
                turn = lambda q: (back - math.atan2(q[1] - p[1], q[0] - p[0])) % (2 * math.pi) or 2 * math.pi  # noqa: E731, B023
                q = min(ways, key=turn)
            else:
                q = ways[0]
            ways.remove(q)
            if not ways:
                del after[p]
            if q in at:  # a loop is closed: split it off
                i = at[q]
                out.append([*path[i:], q])
                for gone in path[i + 1 :]:
                    del at[gone]
                path = path[: i + 1]
                if i == 0:
                    break
            else:
                at[q] = len(path)
                path.append(q)
    return out


def _polygons(rings: list) -> list:
    """Outer rings with the holes that lie in them."""
    outer = sorted((r for r in rings if _area(r) > 0), key=_area)
    out = [[r] for r in outer]
    for hole in (r for r in rings if _area(r) < 0):
        probe = geo._inner_point([hole])
        next(p for p in out if geo.in_polygon(probe, [p[0]]) == 1).append(hole)
    return out


def _chains(pieces: list) -> list:
    """Undirected pieces joined to lines at points that exactly two of them have."""
    ends: dict = {}
    for i, (p, q) in enumerate(pieces):
        ends.setdefault(p, []).append(i)
        ends.setdefault(q, []).append(i)
    used, out = set(), []
    order = [i for p, at in ends.items() if len(at) != 2 for i in at] + list(range(len(pieces)))
    for i in order:
        if i in used:
            continue
        used.add(i)
        p, q = pieces[i]
        if len(ends[p]) == 2 and len(ends[q]) != 2:
            p, q = q, p
        line = [p, q]
        while len(ends[line[-1]]) == 2:
            rest = [j for j in ends[line[-1]] if j not in used]
            if not rest:
                break
            used.add(rest[0])
            a, b = pieces[rest[0]]
            line.append(b if a == line[-1] else a)
        out.append(line)
    return out


def _assembled(points: list, lines: list, polygons: list):
    """One geometry of the simplest kind that holds the parts."""
    out = []
    for kind, found in (("POINT", points), ("LINESTRING", lines), ("POLYGON", polygons)):
        if found:
            out.append((kind, found[0]) if len(found) == 1 else ("MULTI" + kind, found))
    return out[0] if len(out) == 1 else ("GEOMETRYCOLLECTION", out)


def overlay(name: str, a, b):
    """The set operation on two geometries of any kind; an empty result is an empty collection."""
    keep = OPERATIONS[name]
    ga, gb = geo.parts(a), geo.parts(b)
    known: dict = {}
    snap = lambda p: known.setdefault((round(p[0], 9), round(p[1], 9)), p)
    segments = [(p, q) for g in (ga, gb) for p, q in geo._segments(g) if p != q]
    loose = [*ga[0], *gb[0]]
    for p in [*loose, *(p for s in segments for p in s)]:
        snap(p)
    others = [*segments, *((p, p) for p in loose)]
    pieces: dict = {}
    for p, q in segments:
        at = [snap((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))) for t in geo._cuts(p, q, others)]
        for x, y in zip(at, at[1:], strict=False):
            if x != y:
                pieces[min(x, y), max(x, y)] = None
    areas = [([], [], g[2]) for g in (ga, gb)]
    edges = []
    for p, q in pieces:
        size = math.hypot(q[0] - p[0], q[1] - p[1])
        step = 1e-6 * max(1e-3, size) / size
        x, y = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2
        dx, dy = -(q[1] - p[1]) * step, (q[0] - p[0]) * step
        left, right = (keep(*[geo.where(s, g) == 1 for g in areas]) for s in ((x + dx, y + dy), (x - dx, y - dy)))
        if left != right:
            edges.append((p, q) if left else (q, p))
    polygons = _polygons(_rings(edges))
    held = lambda p: keep(geo.where(p, ga) >= 0, geo.where(p, gb) >= 0)
    middle = lambda s: ((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2)
    lines = _chains([s for s in pieces if held(middle(s)) and geo.where(middle(s), ([], [], polygons)) < 0])
    corners = dict.fromkeys([*map(snap, loose), *(p for s in pieces for p in s)])
    points = sorted(p for p in corners if held(p) and geo.where(p, ([], lines, polygons)) < 0)
    return _assembled(points, lines, polygons)
