"""Geometry on WKB columns: reading and writing, measures, and the simple-feature relations.

Geometries are little-endian WKB in longitude and latitude. Functions on whole
columns are Arrow-batched; bounding boxes are plain columns, so filters and grid
joins on them stay inside code generation. Relations are worked out on points,
segments and rings: a geometry's points are cut at all crossings with the other
one, and each piece is inside, on the boundary or outside. Set operations are in
the overlay module.
"""

from __future__ import annotations

import json
import math
import re
import struct
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import TesseraError

# WKB type codes.
CODES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7}
NAMES = {v: k for k, v in CODES.items()}
EARTH_RADIUS = 6_371_008.7714
POINT_HEAD = struct.pack("<BI", 1, CODES["POINT"])
POINT_BYTES = len(POINT_HEAD) + 16

TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")


class InvalidGeometry(TesseraError):
    """The text or bytes are no geometry."""


def strip_crs(text: str) -> str:
    """A WKT literal without its leading CRS IRI."""
    return re.sub(r"^\s*<[^>]*>\s*", "", text)


def parse_wkt(text: str):
    """(kind, coordinates): nested lists of (x, y)."""
    text = strip_crs(text)
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise InvalidGeometry(f"invalid WKT near {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        t = tokens[at]
        if not t or want and t != want:
            raise InvalidGeometry(f"invalid WKT {text[:40]!r}")
        at += 1
        return t

    def items(one):
        nonlocal at
        if tokens[at].upper() == "EMPTY":
            at += 1
            return []
        take("(")
        out = [one()]
        while tokens[at] == ",":
            at += 1
            out.append(one())
        take(")")
        return out

    def pair():
        try:
            x, y = float(take()), float(take())
        except ValueError as e:
            raise InvalidGeometry(f"invalid WKT {text[:40]!r}") from e
        while re.match(r"[-+.0-9]", tokens[at] or "x"):
            take()  # further ordinates are read and left out
        return (x, y)

    def loose_pair():
        nonlocal at
        if tokens[at] == "(":
            take("(")
            p = pair()
            take(")")
            return p
        return pair()

    def geometry():
        nonlocal at
        kind = take().upper()
        if tokens[at].upper() in ("Z", "M", "ZM"):
            at += 1
        if kind not in CODES:
            raise InvalidGeometry(f"unknown geometry {kind}")
        if kind == "POINT":
            found = items(pair)
            return kind, found[0] if found else None
        body = {"LINESTRING": pair, "POLYGON": lambda: items(pair), "MULTIPOINT": loose_pair, "MULTILINESTRING": lambda: items(pair), "MULTIPOLYGON": lambda: items(lambda: items(pair)), "GEOMETRYCOLLECTION": geometry}[kind]
        return kind, items(body)

    out = geometry()
    if tokens[at]:
        raise InvalidGeometry(f"text after the geometry: {tokens[at]!r}")
    return out


def to_wkb(g) -> bytes:
    kind, c = g
    head = struct.pack("<BI", 1, CODES[kind])
    run = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    if kind == "POINT":
        return head + struct.pack("<dd", *(c or (math.nan, math.nan)))
    if kind == "LINESTRING":
        return head + run(c)
    if kind == "POLYGON":
        return head + struct.pack("<I", len(c)) + b"".join(map(run, c))
    part = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}.get(kind)
    return head + struct.pack("<I", len(c)) + b"".join(to_wkb((part, x) if part else x) for x in c)


def from_wkb(data: bytes):
    at = 0

    def read(form: str):
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise InvalidGeometry("the WKB is cut off")
        v = struct.unpack_from(form, data, at)
        at += size
        return v

    def geometry():
        order = "<" if read("<B")[0] == 1 else ">"
        code = read(order + "I")[0]
        extra = {0: 0, 1: 1, 2: 1, 3: 2}.get(code % 10_000 // 1000, 0)
        kind = NAMES.get(code % 1000)
        if kind is None:
            raise InvalidGeometry(f"unknown WKB type {code}")
        pair = lambda: read(order + "dd" + "d" * extra)[:2]
        count = lambda: read(order + "I")[0]
        if kind == "POINT":
            p = pair()
            return kind, None if math.isnan(p[0]) else p
        if kind == "LINESTRING":
            return kind, [pair() for _ in range(count())]
        if kind == "POLYGON":
            return kind, [[pair() for _ in range(count())] for _ in range(count())]
        parts = [geometry() for _ in range(count())]
        return kind, parts if kind == "GEOMETRYCOLLECTION" else [p[1] for p in parts]

    return geometry()


def _n(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def to_wkt(g) -> str:
    kind, c = g
    if not c:
        return f"{kind} EMPTY"
    p = lambda q: f"{_n(q[0])} {_n(q[1])}"
    run = lambda ps: "(" + ", ".join(map(p, ps)) + ")"
    deep = lambda rs: "(" + ", ".join(map(run, rs)) + ")"
    body = {"POINT": lambda: f"({p(c)})", "LINESTRING": lambda: run(c), "MULTIPOINT": lambda: "(" + ", ".join(f"({p(q)})" for q in c) + ")", "POLYGON": lambda: deep(c), "MULTILINESTRING": lambda: deep(c)}
    if kind in body:
        return f"{kind} {body[kind]()}"
    return f"{kind} (" + ", ".join(deep(x) if kind == "MULTIPOLYGON" else to_wkt(x) for x in c) + ")"


def to_geojson(g) -> dict:
    kind, c = g
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    if kind == "GEOMETRYCOLLECTION":
        return {"type": "GeometryCollection", "geometries": [to_geojson(x) for x in c]}
    lists = lambda v: [lists(x) for x in v] if isinstance(v, (list, tuple)) else v
    return {"type": names[kind], "coordinates": lists(c or [])}


# ---- plane geometry ---------------------------------------------------------------------------------------------


def parts(g) -> tuple[list, list, list]:
    """(points, lines, polygons) of any geometry."""
    kind, c = g
    if not c:
        return [], [], []
    if kind == "GEOMETRYCOLLECTION":
        out = ([], [], [])
        for x in c:
            for a, b in zip(out, parts(x), strict=True):
                a += b
        return out
    return {"POINT": ([c], [], []), "MULTIPOINT": (c, [], []), "LINESTRING": ([], [c], []), "MULTILINESTRING": ([], c, []), "POLYGON": ([], [], [c]), "MULTIPOLYGON": ([], [], c)}[kind]


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def on_segment(p, a, b, tol: float = 1e-12) -> bool:
    scale = max(1.0, abs(b[0] - a[0]) + abs(b[1] - a[1]))
    return abs(_cross(a, b, p)) <= tol * scale * scale and min(a[0], b[0]) - tol <= p[0] <= max(a[0], b[0]) + tol and min(a[1], b[1]) - tol <= p[1] <= max(a[1], b[1]) + tol


def in_polygon(p, rings) -> int:
    """1 inside, 0 on the boundary, -1 outside."""
    inside = False
    for ring in rings:
        for a, b in zip(ring, ring[1:], strict=False):
            if on_segment(p, a, b):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return 1 if inside else -1


def _ends(lines) -> set:
    """Boundary points of lines: ends that an odd number of lines have."""
    count: dict = {}
    for line in lines:
        for p in (line[0], line[-1]):
            count[p] = count.get(p, 0) + 1
    return {p for p, n in count.items() if n % 2}


def where(p, g) -> int:
    """1 in the interior, 0 on the boundary, -1 outside of a geometry's points, lines and polygons."""
    points, lines, polygons = g
    best = -1
    for rings in polygons:
        best = max(best, in_polygon(p, rings))
    if best == 1:
        return 1
    if any(on_segment(p, a, b) for line in lines for a, b in zip(line, line[1:], strict=False)):
        return max(best, 0 if p in _ends(lines) else 1)
    if any(abs(p[0] - q[0]) < 1e-12 and abs(p[1] - q[1]) < 1e-12 for q in points):
        return 1
    return best


def _segments(g):
    _, lines, polygons = g
    for run in [*lines, *(r for rings in polygons for r in rings)]:
        yield from zip(run, run[1:], strict=False)


def _cuts(a, b, others) -> list[float]:
    """Parameters at which the segment a-b meets other segments or points."""
    out = [0.0, 1.0]
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    for c, d in others:
        den = dx * (d[1] - c[1]) - dy * (d[0] - c[0])
        if den:
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
            u = ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / den
            if -1e-12 <= u <= 1 + 1e-12 and 0 < t < 1:
                out.append(t)
        for p in (c, d):
            if size and on_segment(p, a, b):
                out.append(min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)))
    return sorted(set(out))


def _inner_point(rings):
    """A point in the interior of a polygon, by a scan line between vertices."""
    ys = sorted({p[1] for r in rings for p in r})
    for lo, hi in zip(ys, ys[1:], strict=False):
        y = (lo + hi) / 2
        xs = sorted((b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:], strict=False) if (a[1] > y) != (b[1] > y))
        for x0, x1 in zip(xs[::2], xs[1::2], strict=False):
            if x1 > x0:
                return ((x0 + x1) / 2, y)
    return rings[0][0]


def relate(a, b) -> dict[str, int]:
    """Dimensions (-1: empty) of interior, boundary and exterior meetings of two geometries, keyed II, IB, IE, BI, BB, BE, EI, EB."""
    ga, gb = parts(a), parts(b)
    m = dict.fromkeys(("II", "IB", "IE", "BI", "BB", "BE", "EI", "EB", "EE"), -1)

    def note(one: int, other: int, dim: int, swap: bool) -> None:
        k = {1: "I", 0: "B", -1: "E"}
        key = k[one] + k[other]
        key = key[::-1] if swap else key
        m[key] = max(m[key], dim)

    for g, h, swap in ((ga, gb, False), (gb, ga, True)):
        points, lines, polygons = g
        for p in points:
            note(1, where(p, h), 0, swap)
        others = [*_segments(h), *((p, p) for p in h[0])]
        rings = [r for rs in polygons for r in rs]
        ends = _ends(lines) if lines else set()
        for run, own in [*((line, 1) for line in lines), *((r, 0) for r in rings)]:
            for p, q in zip(run, run[1:], strict=False):
                t = _cuts(p, q, others)
                at = [(p[0] + s * (q[0] - p[0]), p[1] + s * (q[1] - p[1])) for s in t]
                at[0], at[-1] = p, q
                for x in at:
                    note(0 if own and x in ends else own, where(x, h), 0, swap)
                for x, y in zip(at, at[1:], strict=False):
                    if x != y:
                        note(own, where(((x[0] + y[0]) / 2, (x[1] + y[1]) / 2), h), 1, swap)
        # areas: beside every piece of either boundary, and one point inside
        for rs in polygons:
            probes = [_inner_point(rs)]
            for p, q in [*_segments(g), *_segments(h)]:
                t = _cuts(p, q, [*others, *_segments(g)])
                for s0, s1 in zip(t, t[1:], strict=False):
                    s = (s0 + s1) / 2
                    x, y = p[0] + s * (q[0] - p[0]), p[1] + s * (q[1] - p[1])
                    size = math.hypot(q[0] - p[0], q[1] - p[1])
                    if size:
                        e = 1e-7 * max(1e-3, size * (s1 - s0))
                        nx, ny = -(q[1] - p[1]) / size * e, (q[0] - p[0]) / size * e
                        probes += [(x + nx, y + ny), (x - nx, y - ny)]
            for x in probes:
                if in_polygon(x, rs) == 1:
                    side = where(x, h)
                    if side == 1 and not h[2] or side == 0:
                        side = -1
                    note(1, side, 2, swap)
    return m


def dimension(g) -> int:
    points, lines, polygons = parts(g)
    return 2 if polygons else 1 if lines else 0 if points else -1


def intersects(a, b) -> bool:
    m = relate(a, b)
    return max(m["II"], m["IB"], m["BI"], m["BB"]) >= 0


def within(a, b) -> bool:
    m = relate(a, b)
    return m["II"] >= 0 and m["IE"] < 0 and m["BE"] < 0


def equals(a, b) -> bool:
    m = relate(a, b)
    return m["II"] >= 0 and max(m["IE"], m["BE"], m["EI"], m["EB"]) < 0


def touches(a, b) -> bool:
    m = relate(a, b)
    return m["II"] < 0 and max(m["IB"], m["BI"], m["BB"]) >= 0


def crosses(a, b) -> bool:
    m, da, db = relate(a, b), dimension(a), dimension(b)
    if da == db == 1:
        return m["II"] == 0
    if da < db:
        return m["II"] >= 0 and m["IE"] >= 0
    return da > db and m["II"] >= 0 and m["EI"] >= 0


def overlaps(a, b) -> bool:
    m, d = relate(a, b), dimension(a)
    return d == dimension(b) and m["II"] == d and m["IE"] >= 0 and m["EI"] >= 0


RELATIONS = {"sfEquals": equals, "sfDisjoint": lambda a, b: not intersects(a, b), "sfIntersects": intersects, "sfTouches": touches, "sfCrosses": crosses, "sfWithin": within, "sfContains": lambda a, b: within(b, a), "sfOverlaps": overlaps}


def box(g):
    """(xmin, ymin, xmax, ymax), None if empty."""
    points, lines, polygons = parts(g)
    every = [*points, *(p for run in lines for p in run), *(p for rs in polygons for r in rs for p in r)]
    if not every:
        return None
    xs, ys = [p[0] for p in every], [p[1] for p in every]
    return min(xs), min(ys), max(xs), max(ys)


def envelope(g):
    b = box(g)
    if b is None:
        return "POLYGON", []
    x0, y0, x1, y1 = b
    return "POLYGON", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]]


def boundary(g):
    points, lines, polygons = parts(g)
    if polygons:
        rings = [r for rs in polygons for r in rs]
        return ("LINESTRING", rings[0]) if len(rings) == 1 else ("MULTILINESTRING", rings)
    if lines:
        return "MULTIPOINT", sorted(_ends(lines))
    return "GEOMETRYCOLLECTION", []


def convex_hull(g):
    points, lines, polygons = parts(g)
    every = sorted({*points, *(p for run in lines for p in run), *(p for rs in polygons for r in rs for p in r)})
    if len(every) < 3:
        return ("POINT", every[0]) if len(every) == 1 else ("LINESTRING", every)
    halves = []
    for run in (every, every[::-1]):
        half: list = []
        for p in run:
            while len(half) > 1 and _cross(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    hull = halves[0] + halves[1]
    return ("LINESTRING", [every[0], every[-1]]) if len(hull) < 3 else ("POLYGON", [[*hull, hull[0]]])


def distance(a, b) -> float:
    if intersects(a, b):
        return 0.0

    def point_segment(p, c, d) -> float:
        dx, dy = d[0] - c[0], d[1] - c[1]
        size = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((p[0] - c[0]) * dx + (p[1] - c[1]) * dy) / size)) if size else 0.0
        return math.hypot(p[0] - c[0] - t * dx, p[1] - c[1] - t * dy)

    best = math.inf
    for g, h in ((parts(a), parts(b)), (parts(b), parts(a))):
        pieces = [*_segments(h), *((p, p) for p in h[0])]
        for p in [*g[0], *(x for s in _segments(g) for x in s)]:
            best = min(best, min((point_segment(p, c, d) for c, d in pieces), default=math.inf))
    return best


# ---- columns ----------------------------------------------------------------------------------------------------


def _column(fn, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda v: None if v is None else fn(v))

    return run


def _coordinates(column: pd.Series) -> np.ndarray:
    """x and y of each row that is a plain point: little-endian WKB of two finite numbers; NaN for all others."""
    out = np.full((len(column), 2), np.nan)
    plain = np.fromiter((v is not None and len(v) == POINT_BYTES and v[: len(POINT_HEAD)] == POINT_HEAD for v in column), bool, len(column))
    read = np.frombuffer(b"".join(column[plain]), [("head", f"V{len(POINT_HEAD)}"), ("x", "<f8"), ("y", "<f8")])
    out[plain] = np.stack([read["x"], read["y"]], axis=1)
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def _pair(fn, kind: str, points=None):
    """A function of two geometries; `points` does the same for arrays of plain points, at once."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, rest = np.full(len(a), None, object), np.arange(len(a))
        if points is not None:
            p, q = _coordinates(a), _coordinates(b)
            plain = ~np.isnan(p[:, 0] + q[:, 0])
            out[plain] = points(p[plain], q[plain])
            rest = np.flatnonzero(~plain)
        read, x, y = _reader(), a.to_numpy(), b.to_numpy()
        for i in rest:
            if x[i] is not None and y[i] is not None:
                out[i] = fn(read(x[i]), read(y[i]))
        return pd.Series(out, dtype=object)

    return run


def _same(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Points that are one, by the tolerance of where()."""
    return (np.abs(p - q) < 1e-12).all(1)


def _related_points(fn):
    """A relation of two points hangs on whether they are one."""
    same, other = (fn(("POINT", (0.0, 0.0)), ("POINT", (x, 0.0))) for x in (0.0, 1.0))
    return lambda p, q: np.where(_same(p, q), same, other)


def _distant_points(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return np.where(_same(p, q), 0.0, np.fromiter(map(math.hypot, d[:, 0].tolist(), d[:, 1].tolist()), float, len(d)))


def _reader():
    """from_wkb that reads a geometry once which comes again and again, as a constant does."""
    known: dict[bytes, tuple] = {}

    def read(wkb: bytes):
        found = known.get(wkb)
        if found is None:
            if len(known) >= 256:
                known.clear()
            found = known[wkb] = from_wkb(wkb)
        return found

    return read


WKT_LOOK = r"(?i)^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s*(\(|EMPTY)"


def text_to_geojson(c: Column) -> Column:
    """GeoJSON of a WKT text, null if it is none."""

    def convert(v: str) -> str | None:
        try:
            return json.dumps(to_geojson(parse_wkt(strip_crs(v))), separators=(",", ":"))
        except TesseraError:
            return None

    return _column(convert, "string")(c)


def st_geomfromtext(c: Column) -> Column:
    return _column(lambda v: to_wkb(parse_wkt(v)), "binary")(c)


def st_astext(c: Column) -> Column:
    return _column(lambda v: to_wkt(from_wkb(v)), "string")(c)


def st_asgeojson(c: Column) -> Column:
    import json

    return _column(lambda v: json.dumps(to_geojson(from_wkb(v)), separators=(",", ":")), "string")(c)


def _point():
    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(p) or pd.isna(q) else struct.pack("<BIdd", 1, 1, p, q) for p, q in zip(a, b, strict=True)], dtype=object)

    return run


def _envelope_of():
    box_of = lambda x0, y0, x1, y1: to_wkb(("POLYGON", [[(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]]))

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if any(map(pd.isna, v)) else box_of(*map(float, v)) for v in zip(a, b, c, d, strict=True)], dtype=object)

    return run


def st_point(x: Column, y: Column) -> Column:
    return _point()(x.cast("double"), y.cast("double"))


def st_makeenvelope(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The polygon of a box."""
    return _envelope_of()(*(c.cast("double") for c in (x0, y0, x1, y1)))


def st_geometrytype(c: Column) -> Column:
    return _column(lambda v: from_wkb(v)[0], "string")(c)


def bounds(c: Column) -> Column:
    """struct<xmin, ymin, xmax, ymax> of a geometry, null if it is null or empty."""

    @F.pandas_udf("xmin double, ymin double, xmax double, ymax double")
    def run(a: pd.Series) -> pd.DataFrame:
        p = _coordinates(a)
        out, wkb = np.concatenate([p, p], axis=1), a.to_numpy()
        for i in np.flatnonzero(np.isnan(p[:, 0])):
            if wkb[i] is not None and (found := box(from_wkb(wkb[i]))):
                out[i] = found
        return pd.DataFrame(out, columns=["xmin", "ymin", "xmax", "ymax"])

    return run(c)


def relation(name: str, a: Column, b: Column) -> Column:
    return _pair(RELATIONS[name], "boolean", _related_points(RELATIONS[name]))(a, b)


def planar_distance(a: Column, b: Column) -> Column:
    return _pair(distance, "double", _distant_points)(a, b)


def _metres(p, q) -> float:
    if p[0] != "POINT" or q[0] != "POINT":
        raise InvalidGeometry("distance in metres is defined for points only")
    (x0, y0), (x1, y1) = p[1], q[1]
    u, v = math.radians(y0), math.radians(y1)
    h = math.sin((v - u) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(x1 - x0) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(h))


def sphere_distance(a: Column, b: Column) -> Column:
    """Haversine metres between two points; anything else raises."""
    return _pair(_metres, "double")(a, b)


CONSTRUCTORS = {"envelope": envelope, "boundary": boundary, "convexHull": convex_hull}


def construct(name: str, c: Column) -> Column:
    return _column(lambda v: to_wkb(CONSTRUCTORS[name](from_wkb(v))), "binary")(c)


SET_OPERATIONS = ("intersection", "union", "difference", "symDifference")


def _combined(name: str):
    from tessera.functions.overlay import overlay

    return _pair(lambda x, y: to_wkb(overlay(name, x, y)), "binary")


def combine(name: str, a: Column, b: Column) -> Column:
    """A set operation on two columns of geometries; null if either is."""
    return _combined(name)(a, b)


def register(spark: SparkSession) -> None:
    """st_ functions over WKB for Spark SQL texts."""
    one = {"st_astext": (to_wkt, "string"), "st_asgeojson": (lambda g: json.dumps(to_geojson(g)), "string"), "st_geometrytype": (lambda g: g[0], "string")}
    one |= {f"st_{n.lower()}": (lambda g, f=f: to_wkb(f(g)), "binary") for n, f in CONSTRUCTORS.items()}
    for name, (fn, kind) in one.items():
        spark.udf.register(name, _column(lambda v, fn=fn: fn(from_wkb(v)), kind))
    spark.udf.register("st_geomfromtext", _column(lambda v: to_wkb(parse_wkt(strip_crs(v))), "binary"))
    for name, fn in RELATIONS.items():
        spark.udf.register(f"st_{name[2:].lower()}", _pair(fn, "boolean", _related_points(fn)))
    spark.udf.register("st_distance", _pair(distance, "double", _distant_points))
    spark.udf.register("st_distance_sphere", _pair(_metres, "double"))
    spark.udf.register("st_point", _point())
    spark.udf.register("st_makeenvelope", _envelope_of())
    for i, name in enumerate(("st_xmin", "st_ymin", "st_xmax", "st_ymax")):
        spark.udf.register(name, _column(lambda v, i=i: (box(from_wkb(v)) or (None,) * 4)[i], "double"))
    for name in SET_OPERATIONS:
        spark.udf.register(f"st_{name.lower()}", _combined(name))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """minx,miny,maxx,maxy."""
    fields = text.split(",")
    if len(fields) != 4:
        raise TesseraError("a bbox has four numbers: minx,miny,maxx,maxy")
    try:
        x0, y0, x1, y1 = map(float, fields)
    except ValueError as e:
        raise TesseraError("a bbox has four numbers: minx,miny,maxx,maxy") from e
    if x0 > x1 or y0 > y1:
        raise TesseraError("a bbox's minimum is above its maximum")
    return x0, y0, x1, y1


LEVELS = 24  # of cells, each twice as wide as those of the level before
BROADCAST_BYTES = 4 << 20  # of the cells of one side that are broadcast at most, as counted, not as Spark estimates them
ROW_BYTES = 256  # of a row in a cell beside its geometry


def spatial_join(left: DataFrame, right: DataFrame, l_geo: str, r_geo: str, name: str, margin: float = 0.0, exact=None) -> DataFrame:
    """Pairs of rows in a relation that implies boxes which meet within a margin: equi-join on grid cells, box test, then the exact relation (or the given one).

    Cells suit the data: the finest are such that few boxes share one if they are spread evenly, and a box lives at the level where it
    covers four cells at most. It meets the other side's boxes of its own level and coarser ones, so a box as large as the world is four
    rows, not one for each fine cell; levels beyond those that the other side has are left out, so points that meet points are one row each.
    A pair is taken in the one cell of the coarser of its levels that holds the lower corner of its boxes' overlap, so no pair comes twice
    and none has to be made distinct. A side is broadcast only if its counted rows are few: an estimate from the size of compressed files
    knows nothing of cells. Crowded cells are left to Spark's splitting of skewed joins.
    """
    if name == "sfDisjoint":
        raise TesseraError("disjoint pairs have no common grid cell")
    boxed = lambda df, c, p: df.withColumn(p, bounds(F.col(c))).filter(F.col(f"{p}.xmin").isNotNull())
    a, b = boxed(left, l_geo, "_l"), boxed(right, r_geo, "_r")
    if margin:
        a = a.withColumn("_l", F.struct((F.col("_l.xmin") - margin).alias("xmin"), (F.col("_l.ymin") - margin).alias("ymin"), (F.col("_l.xmax") + margin).alias("xmax"), (F.col("_l.ymax") + margin).alias("ymax")))
    size = lambda p: F.greatest(F.col(f"{p}.xmax") - F.col(f"{p}.xmin"), F.col(f"{p}.ymax") - F.col(f"{p}.ymin"))
    sides = a.select(F.lit(0).alias("side"), F.col("_l").alias("b"), F.length(l_geo).alias("bytes")).union(b.select(F.lit(1), F.col("_r"), F.length(r_geo)))
    found = {r["side"]: r for r in sides.groupBy("side").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *[f(f"b.{k}").alias(f"{k}_{f.__name__}") for k in ("xmin", "ymin", "xmax", "ymax") for f in (F.min, F.max)], F.min(size("b")).alias("least"), F.max(size("b")).alias("most")).collect()}
    over = lambda k, f: f((r[f"{k}_{f.__name__}"] for r in found.values()), default=0.0)
    n, x0, y0 = sum(r["n"] for r in found.values()), over("xmin", min), over("ymin", min)
    width = max(over("xmax", max) - x0, over("ymax", max) - y0)
    depth = min(LEVELS, max(0, math.ceil(math.log2(max(1, n)) / 2)))
    cell = (width or 1.0) / 2**depth
    wider = [cell * 2**k for k in range(depth)]
    levels = {side: tuple(sum(r[k] > w for w in wider) for k in ("least", "most")) for side, r in found.items()}

    def cells(df: DataFrame, p: str, other: int) -> DataFrame:
        level = reduce(lambda x, y: x + y, [(size(p) > w).cast("int") for w in wider], F.lit(0))
        at = lambda edge, low: F.floor((F.col(f"{p}.{edge}") - F.lit(float(low))) / (F.lit(cell) * F.pow(F.lit(2.0), F.col(f"{p}_at"))))
        lo, hi = levels.get(other, (0, 0))
        df = df.withColumn(f"{p}_own", level).withColumn(f"{p}_at", F.explode(F.sequence(F.greatest(f"{p}_own", F.lit(lo)), F.greatest(f"{p}_own", F.lit(hi)))))
        df = df.withColumn(f"{p}_x", F.explode(F.sequence(at("xmin", x0), at("xmax", x0))))
        return df.withColumn(f"{p}_y", F.explode(F.sequence(at("ymin", y0), at("ymax", y0))))

    def heft(side: int) -> int:
        """Bytes of a side's cells at most."""
        (own, _), (lo, hi) = levels.get(side, (0, 0)), levels.get(1 - side, (0, 0))
        return 4 * (max(own, hi) - max(own, lo) + 1) * (found[side]["n"] * ROW_BYTES + (found[side]["bytes"] or 0)) if side in found else 0

    a, b = cells(a, "_l", 1), cells(b, "_r", 0)
    if min(heft(0), heft(1)) > BROADCAST_BYTES:
        b = b.hint("merge")
    elif heft(0) < heft(1):
        a = F.broadcast(a)
    else:
        b = F.broadcast(b)
    corner = lambda k, low: F.floor((F.greatest(F.col(f"_l.{k}"), F.col(f"_r.{k}")) - F.lit(float(low))) / (F.lit(cell) * F.pow(F.lit(2.0), F.col("_l_at"))))
    meet = (F.col("_l.xmin") <= F.col("_r.xmax")) & (F.col("_r.xmin") <= F.col("_l.xmax")) & (F.col("_l.ymin") <= F.col("_r.ymax")) & (F.col("_r.ymin") <= F.col("_l.ymax"))
    same = (F.col("_l_at") == F.col("_r_at")) & (F.col("_l_x") == F.col("_r_x")) & (F.col("_l_y") == F.col("_r_y"))
    pairs = a.join(b, same & meet).filter(F.col("_l_at") == F.greatest("_l_own", "_r_own")).filter((F.col("_l_x") == corner("xmin", x0)) & (F.col("_l_y") == corner("ymin", y0)))
    pairs = pairs.drop(*(f"{p}{k}" for p in ("_l", "_r") for k in ("", "_own", "_at", "_x", "_y")))
    return pairs.filter(exact if exact is not None else relation(name, F.col(l_geo), F.col(r_geo)))
