"""Geometry without native libraries: WKB and WKT, exact predicates, quadkeys, thinning and simplification.

Predicates put a comparison of bounds first, as a column expression that reaches the scan, and then call an
Arrow-batched kernel on what is left. The kernel finds the nine intersections of interior, boundary and exterior from
sample points: vertices, the middles of all edges cut at all crossings, and points just beside ring edges, which
between them lie in every face, edge and node that the two geometries form.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: WKB type codes (fixed by the format).
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
CODES = {name: code for code, name in KINDS.items()}


class Geometry:
    """Parts: points (N x 2), lines (list of N x 2) and polygons (list of lists of closed rings)."""

    def __init__(self, kind: str, points=None, lines=(), polygons=(), parts=()):
        self.kind = kind
        self.points = np.asarray(points if points is not None else np.zeros((0, 2)), dtype=float).reshape(-1, 2)
        self.lines, self.polygons, self.parts = [np.asarray(x, dtype=float) for x in lines], [[np.asarray(r, dtype=float) for r in p] for p in polygons], list(parts)

    @property
    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0

    def coordinates(self) -> np.ndarray:
        found = [self.points, *self.lines, *(r for p in self.polygons for r in p)]
        return np.concatenate(found) if found else np.zeros((0, 2))

    def bounds(self) -> tuple[float, float, float, float]:
        c = self.coordinates()
        return (*c.min(axis=0), *c.max(axis=0)) if len(c) else (math.inf, math.inf, -math.inf, -math.inf)


def _joined(kind: str, parts: list[Geometry]) -> Geometry:
    points = [g.points for g in parts if len(g.points)]
    return Geometry(kind, np.concatenate(points) if points else None, [x for g in parts for x in g.lines], [p for g in parts for p in g.polygons], parts)


def from_wkb(data: bytes) -> Geometry:
    at = 0

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return out

    def run() -> np.ndarray:
        (n,) = take("I")
        return np.array(take(f"{2 * n}d")).reshape(n, 2)

    def one() -> Geometry:
        nonlocal at, order
        order = "<" if data[at] else ">"
        at += 1
        (code,) = take("I")
        kind = KINDS[code & 0xFF]
        if kind == "POINT":
            xy = take("2d")
            return Geometry(kind, [] if math.isnan(xy[0]) else [xy])
        if kind == "LINESTRING":
            return Geometry(kind, lines=[run()])
        if kind == "POLYGON":
            (n,) = take("I")
            return Geometry(kind, polygons=[[run() for _ in range(n)]])
        (n,) = take("I")
        return _joined(kind, [one() for _ in range(n)])

    order = "<"
    return one()


def to_wkb(g: Geometry) -> bytes:
    head = struct.pack("<BI", 1, CODES[g.kind])
    run = lambda c: struct.pack("<I", len(c)) + np.ascontiguousarray(c, dtype="<f8").tobytes()
    if g.kind == "POINT":
        return head + (g.points[0].astype("<f8").tobytes() if len(g.points) else struct.pack("<2d", math.nan, math.nan))
    if g.kind == "LINESTRING":
        return head + run(g.lines[0])
    if g.kind == "POLYGON":
        return head + struct.pack("<I", len(g.polygons[0])) + b"".join(run(r) for r in g.polygons[0])
    return head + struct.pack("<I", len(g.parts)) + b"".join(to_wkb(p) for p in g.parts)


def from_wkt(text: str) -> Geometry:
    tokens = re.findall(r"[A-Za-z]+|[-+0-9.eE]+|[(),]", text)
    at = 0

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def nest():
        """A list of lists of coordinate pairs, as deep as the parentheses."""
        if take() != "(":
            raise ValueError(f"not WKT: {text}")
        out = []
        while True:
            if tokens[at] == "(":
                out.append(nest())
            else:
                pair = []
                while tokens[at] not in ",)":
                    pair.append(float(take()))
                out.append(tuple(pair[:2]))
            if take() == ")":
                return out

    def one() -> Geometry:
        nonlocal at
        kind = take().upper()
        if tokens[at : at + 1] == ["EMPTY"] or at < len(tokens) and tokens[at].upper() == "EMPTY":
            at += 1
            return _joined(kind, []) if kind in CODES and CODES[kind] > 3 else Geometry(kind, lines=[np.zeros((0, 2))] if kind == "LINESTRING" else (), polygons=[[]] if kind == "POLYGON" else ())
        if kind == "GEOMETRYCOLLECTION":
            take()
            parts = [one()]
            while take() == ",":
                parts.append(one())
            return _joined(kind, parts)
        c = nest()
        if kind == "POINT":
            return Geometry(kind, c)
        if kind == "LINESTRING":
            return Geometry(kind, lines=[c])
        if kind == "POLYGON":
            return Geometry(kind, polygons=[c])
        single = {"MULTIPOINT": lambda x: Geometry("POINT", x if isinstance(x, list) else [x]), "MULTILINESTRING": lambda x: Geometry("LINESTRING", lines=[x]), "MULTIPOLYGON": lambda x: Geometry("POLYGON", polygons=[x])}[kind]
        return _joined(kind, [single(x) for x in c])

    return one()


def to_wkt(g: Geometry) -> str:
    number = lambda x: repr(int(x)) if float(x).is_integer() else repr(float(x))
    run = lambda c: "(" + ", ".join(f"{number(x)} {number(y)}" for x, y in c) + ")"
    body = {
        "POINT": lambda: run(g.points), "LINESTRING": lambda: run(g.lines[0]), "POLYGON": lambda: "(" + ", ".join(map(run, g.polygons[0])) + ")",
        "MULTIPOINT": lambda: "(" + ", ".join(run([p]) for p in g.points) + ")", "MULTILINESTRING": lambda: "(" + ", ".join(map(run, g.lines)) + ")",
        "MULTIPOLYGON": lambda: "(" + ", ".join("(" + ", ".join(map(run, p)) + ")" for p in g.polygons) + ")", "GEOMETRYCOLLECTION": lambda: "(" + ", ".join(map(to_wkt, g.parts)) + ")",
    }
    return f"{g.kind} EMPTY" if not len(g.coordinates()) else f"{g.kind} {body[g.kind]()}"


def _edges(g: Geometry) -> np.ndarray:
    runs = [*g.lines, *(r for p in g.polygons for r in p)]
    found = [np.concatenate([r[:-1], r[1:]], axis=1) for r in runs if len(r) > 1]
    return np.concatenate(found) if found else np.zeros((0, 4))


def _on_edges(p: np.ndarray, edges: np.ndarray, eps: float) -> np.ndarray:
    """Which points lie on any of the edges."""
    if not len(edges) or not len(p):
        return np.zeros(len(p), dtype=bool)
    return edge_distance(p, edges) <= eps


def edge_distance(p: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each point's distance from the nearest edge."""
    a, d = edges[None, :, :2], (edges[:, 2:] - edges[:, :2])[None]
    size = np.maximum((d**2).sum(axis=2), 1e-300)
    t = np.clip(((p[:, None, :] - a) * d).sum(axis=2) / size, 0, 1)
    return np.sqrt((((a + t[..., None] * d) - p[:, None, :]) ** 2).sum(axis=2)).min(axis=1)


def _in_rings(p: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings of a polygon."""
    inside = np.zeros(len(p), dtype=bool)
    for r in rings:
        (x1, y1), (x2, y2) = r[:-1].T, r[1:].T
        up = (y1[None] > p[:, 1:]) != (y2[None] > p[:, 1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = p[:, :1] < (x2 - x1)[None] * (p[:, 1:] - y1[None]) / (y2 - y1)[None] + x1[None]
        inside ^= (up & cross).sum(axis=1) % 2 == 1
    return inside


INTERIOR, BOUNDARY, EXTERIOR = 0, 1, 2


def locate(p: np.ndarray, g: Geometry, eps: float) -> np.ndarray:
    """Interior, boundary or exterior, for each point."""
    inside, edge = np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
    for rings in g.polygons:
        if rings:
            on = _on_edges(p, _edges(Geometry("POLYGON", polygons=[rings])), eps)
            edge |= on
            inside |= _in_rings(p, rings) & ~on
    if g.lines:
        on = _on_edges(p, _edges(Geometry("MULTILINESTRING", lines=g.lines)), eps)
        ends = np.concatenate([x[[0, -1]] for x in g.lines if len(x)])
        times = (np.abs(p[:, None, :] - ends[None]).max(axis=2) <= eps).sum(axis=1)
        inside |= on & (times % 2 == 0)
        edge |= on & (times % 2 == 1)
    if len(g.points):
        inside |= (np.abs(p[:, None, :] - g.points[None]).max(axis=2) <= eps).any(axis=1)
    return np.where(inside, INTERIOR, np.where(edge, BOUNDARY, EXTERIOR))


def _cut(edges: np.ndarray, others: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(middles, directions) of the edges cut where the others meet them."""
    mids, dirs = [], []
    for e in edges:
        a, d = e[:2], e[2:] - e[:2]
        t = [0.0, 1.0]
        if len(others):
            c, f = others[:, :2], others[:, 2:] - others[:, :2]
            det = d[0] * f[:, 1] - d[1] * f[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = ((c[:, 0] - a[0]) * f[:, 1] - (c[:, 1] - a[1]) * f[:, 0]) / det
                u = ((c[:, 0] - a[0]) * d[1] - (c[:, 1] - a[1]) * d[0]) / det
            t += s[(np.abs(det) > 1e-300) & (s > 0) & (s < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)].tolist()
            size = float(d @ d)
            for q in np.concatenate([c, others[:, 2:]]) if size else ():  # ends of others on this edge
                k = float((q - a) @ d) / size
                if 0 < k < 1 and np.abs(a + k * d - q).max() <= eps:
                    t.append(k)
        t = sorted(set(t))
        for lo, hi in zip(t[:-1], t[1:], strict=True):
            mids.append(a + (lo + hi) / 2 * d)
            dirs.append(d)
    return np.array(mids).reshape(-1, 2), np.array(dirs).reshape(-1, 2)


class Relation:
    """Which of the nine intersections are not empty, and whether interiors share more than single points."""

    def __init__(self, a: Geometry, b: Geometry):
        every = np.concatenate([a.coordinates(), b.coordinates()])
        scale = max(1.0, float(np.abs(every).max())) if len(every) else 1.0
        eps = scale * 1e-9
        ea, eb = _edges(a), _edges(b)
        both = np.concatenate([ea, eb])
        samples, lengthy = [every], []
        for edges in (ea, eb):
            mids, dirs = _cut(edges, both, eps)
            if len(mids):
                normal = np.stack([-dirs[:, 1], dirs[:, 0]], axis=1) / np.maximum(np.hypot(*dirs.T), 1e-300)[:, None] * eps * 100
                samples += [mids, mids + normal, mids - normal] if a.dimension == 2 or b.dimension == 2 else [mids]
                lengthy.append(mids)
        for own, other in ((ea, eb), (eb, ea)):  # crossings are nodes
            for e in own:
                mids, _ = _cut(other, e[None], eps)
                samples.append(mids)
        crossings = _crossings(ea, eb)
        p = np.concatenate([*samples, crossings])
        la, lb = locate(p, a, eps), locate(p, b, eps)
        self.m = np.zeros((3, 3), dtype=bool)
        self.m[la, lb] = True
        if lengthy:
            mids = np.concatenate(lengthy)
            self.along = bool(((locate(mids, a, eps) == INTERIOR) & (locate(mids, b, eps) == INTERIOR)).any())
        else:
            self.along = False
        self.da, self.db = a.dimension, b.dimension

    def intersects(self) -> bool:
        return bool(self.m[:2, :2].any())

    def within(self) -> bool:
        return bool(self.m[0, 0] and not self.m[0, 2] and not self.m[1, 2])

    def contains(self) -> bool:
        return bool(self.m[0, 0] and not self.m[2, 0] and not self.m[2, 1])

    def touches(self) -> bool:
        return bool(not self.m[0, 0] and self.m[:2, :2].any())

    def crosses(self) -> bool:
        if self.da == self.db == 1:
            return bool(self.m[0, 0] and not self.along)
        if self.da == self.db:
            return False
        return bool(self.m[0, 0] and (self.m[0, 2] if self.da < self.db else self.m[2, 0]))

    def overlaps(self) -> bool:
        return bool(self.da == self.db and self.m[0, 0] and self.m[0, 2] and self.m[2, 0] and (self.da != 1 or self.along))

    def equals(self) -> bool:
        return bool(self.da == self.db and self.m[0, 0] and not self.m[:2, 2].any() and not self.m[2, :2].any())


def _crossings(ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    if not len(ea) or not len(eb):
        return np.zeros((0, 2))
    a, d = ea[:, None, :2], (ea[:, 2:] - ea[:, :2])[:, None]
    c, f = eb[None, :, :2], (eb[:, 2:] - eb[:, :2])[None]
    det = d[..., 0] * f[..., 1] - d[..., 1] * f[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = ((c[..., 0] - a[..., 0]) * f[..., 1] - (c[..., 1] - a[..., 1]) * f[..., 0]) / det
        u = ((c[..., 0] - a[..., 0]) * d[..., 1] - (c[..., 1] - a[..., 1]) * d[..., 0]) / det
    i, j = np.nonzero((np.abs(det) > 1e-300) & (s >= 0) & (s <= 1) & (u >= 0) & (u <= 1))
    return a[i, 0] + s[i, j][:, None] * d[i, 0]


def distance(a: Geometry, b: Geometry) -> float:
    if Relation(a, b).intersects():
        return 0.0
    best = math.inf
    for x, y in ((a, b), (b, a)):
        p = x.coordinates()
        if len(p) and len(_edges(y)):
            best = min(best, float(edge_distance(p, _edges(y)).min()))
    if len(a.points) and len(b.points):
        best = min(best, float(np.hypot(*(a.points[:, None] - b.points[None]).transpose(2, 0, 1)).min()))
    return best


PREDICATES: dict[str, Callable[[Geometry, Geometry], bool]] = {
    "INTERSECTS": lambda a, b: Relation(a, b).intersects(), "DISJOINT": lambda a, b: not Relation(a, b).intersects(), "CONTAINS": lambda a, b: Relation(a, b).contains(), "WITHIN": lambda a, b: Relation(a, b).within(),
    "CROSSES": lambda a, b: Relation(a, b).crosses(), "OVERLAPS": lambda a, b: Relation(a, b).overlaps(), "TOUCHES": lambda a, b: Relation(a, b).touches(), "EQUALS": lambda a, b: Relation(a, b).equals(),
}

#: Predicates whose truth needs the bounds to meet, so that a comparison of bounds may go first.
MONOTONE = {"INTERSECTS", "CONTAINS", "WITHIN", "CROSSES", "OVERLAPS", "TOUCHES", "EQUALS", "DWITHIN"}

#: Lengths in metres (fixed values); "degrees" and "" leave the number as it is.
UNITS = {"meters": 1.0, "kilometers": 1000.0, "feet": 0.3048, "statute miles": 1609.344, "nautical miles": 1852.0, "": 1.0, "degrees": 1.0}


def bounds_columns(wkb: str, prefix: str = "") -> Callable[[DataFrame], DataFrame]:
    """Adds minx, miny, maxx, maxy, for layers written without them."""

    @F.pandas_udf("minx double, miny double, maxx double, maxy double")
    def box(data: pd.Series) -> pd.DataFrame:
        found = [from_wkb(x).bounds() if x is not None else (None,) * 4 for x in data]
        return pd.DataFrame(found, columns=["minx", "miny", "maxx", "maxy"])

    return lambda df: df.withColumn("__box", box(wkb)).select("*", *[F.col(f"__box.{c}").alias(prefix + c) for c in ("minx", "miny", "maxx", "maxy")]).drop("__box")


def bbox(x1: float, y1: float, x2: float, y2: float, prefix: str = "") -> Column:
    """Bounds meet the box: four comparisons that the scan can use."""
    c = lambda n: F.col(prefix + n)
    return (c("minx") <= x2) & (c("maxx") >= x1) & (c("miny") <= y2) & (c("maxy") >= y1)


def point_in_box(x: str, y: str, box: tuple[float, float, float, float]) -> Column:
    return F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])


def spatial(name: str, wkb: str, literal: str, distance_: float = 0.0, units: str = "", bounded: bool = True) -> Column:
    """A predicate of a WKB column against a WKT literal; ``bounded`` layers have minx, miny, maxx and maxy."""
    target = from_wkt(literal)
    reach = distance_ * UNITS[units.lower()]

    @F.pandas_udf("boolean")
    def exact(data: pd.Series) -> pd.Series:
        if name in ("DWITHIN", "BEYOND"):
            near = lambda g: distance(g, target) <= reach
            test = near if name == "DWITHIN" else lambda g: not near(g)
        else:
            test = lambda g: PREDICATES[name](g, target)
        return pd.Series([None if x is None else bool(test(from_wkb(x))) for x in data], dtype="object")

    if bounded and name in MONOTONE:
        x1, y1, x2, y2 = target.bounds()
        return bbox(x1 - reach, y1 - reach, x2 + reach, y2 + reach) & exact(F.col(wkb))
    return exact(F.col(wkb))


def quadkey(x: str, y: str, bounds: tuple[float, float, float, float], levels: int) -> Column:
    """The quadrant digits of a point, as one expression: sorted rows lie near each other on the map."""
    cell = lambda c, lo, hi: F.least(F.greatest(F.floor((F.col(c) - lo) / (hi - lo) * (1 << levels)), F.lit(0)), F.lit((1 << levels) - 1)).cast("int")
    ix, iy = cell(x, bounds[0], bounds[2]), cell(y, bounds[1], bounds[3])
    digit = lambda k: (F.shiftright(iy, k).bitwiseAND(1) * 2 + F.shiftright(ix, k).bitwiseAND(1)).cast("string")
    return F.concat(*[digit(k) for k in range(levels - 1, -1, -1)])


def thinned(df: DataFrame, x: str, y: str, key: str, pixel: float) -> DataFrame:
    """One row of each pixel, the one with the smallest key: what a screen map would draw."""
    px, py = F.floor(F.col(x) / pixel), F.floor(F.col(y) / pixel)
    cols = [c for c in df.columns if c != key]
    return df.groupBy(px.alias("__px"), py.alias("__py")).agg(F.min_by(F.struct(key, *cols), key).alias("r")).select("r.*").select(df.columns)


def pixel_geometry(wkb: str, pixel: float) -> Column:
    """Geometries smaller than a pixel become the pixel's middle; others stay."""

    @F.pandas_udf("binary")
    def replace(data: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x1, y1, x2, y2 = from_wkb(x).bounds()
            if x2 - x1 >= pixel or y2 - y1 >= pixel:
                return x
            return to_wkb(Geometry("POINT", [((math.floor(x1 / pixel) + 0.5) * pixel, (math.floor(y1 / pixel) + 0.5) * pixel)]))

        return data.map(one)

    return replace(F.col(wkb))


def simplify_run(c: np.ndarray, tolerance: float) -> np.ndarray:
    """Keeps the ends and, recursively, the farthest point that lies over the tolerance from the chord."""
    keep = np.zeros(len(c), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(c) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        d = edge_distance(c[lo + 1 : hi], np.concatenate([c[lo], c[hi]])[None])
        far = int(d.argmax())
        if d[far] > tolerance:
            keep[lo + 1 + far] = True
            todo += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
    return c[keep]


def simplified(g: Geometry, tolerance: float) -> Geometry:
    """Rings keep four points at least."""
    ring = lambda r: s if len(s := simplify_run(r, tolerance)) >= 4 else r
    if g.parts:
        return _joined(g.kind, [simplified(p, tolerance) for p in g.parts])
    return Geometry(g.kind, g.points, [simplify_run(x, tolerance) for x in g.lines], [[ring(r) for r in p] for p in g.polygons])


def simplify(wkb: str, tolerance: float) -> Column:
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else to_wkb(simplified(from_wkb(x), tolerance)))

    return run(F.col(wkb))


def wkt(wkb: str) -> Column:
    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else to_wkt(from_wkb(x)))

    return run(F.col(wkb))


def _packed(head: bytes, *columns: str) -> Column:
    """WKB of one kind and length: the head, then the columns as little-endian doubles, a batch at a time; null where a
    column is."""

    @F.pandas_udf("binary")
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        values = np.column_stack([pd.to_numeric(c).astype(float) for c in (first, *rest)]).astype("<f8")
        size = 8 * values.shape[1]
        data = values.tobytes()
        known = ~np.isnan(values).any(axis=1)
        return pd.Series([head + data[i * size : (i + 1) * size] if ok else None for i, ok in enumerate(known)], dtype="object")

    return run(*(F.col(c) for c in columns))


def point_wkb(x: str, y: str) -> Column:
    """A little-endian WKB point."""
    return _packed(struct.pack("<BI", 1, 1), x, y)


def line_wkb(x1: str, y1: str, x2: str, y2: str) -> Column:
    """A line of two points."""
    return _packed(struct.pack("<BII", 1, 2, 2), x1, y1, x2, y2)


def box_wkb(x1: str, y1: str, x2: str, y2: str) -> Column:
    """A rectangle as a polygon."""
    return _packed(struct.pack("<BIII", 1, 3, 1, 5), x1, y1, x2, y1, x2, y2, x1, y2, x1, y1)


def envelope_polygon(x1: float, y1: float, x2: float, y2: float) -> str:
    return f"POLYGON (({x1} {y1}, {x2} {y1}, {x2} {y2}, {x1} {y2}, {x1} {y1}))"


def parse_bbox(text: str) -> tuple[float, float, float, float, str | None]:
    """``minx,miny,maxx,maxy[,srs]``."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) not in (4, 5):
        raise ValueError("a bounding box is minx,miny,maxx,maxy[,srs]")
    x1, y1, x2, y2 = map(float, parts[:4])
    if x1 > x2 or y1 > y2:
        raise ValueError("a bounding box's minima come first")
    return x1, y1, x2, y2, parts[4] if len(parts) == 5 else None


#: Earth radius of EPSG:3857 in metres, and the bounds of the two systems (fixed values).
RADIUS = 6378137.0
SYSTEMS = {"EPSG:4326": (-180.0, -90.0, 180.0, 90.0), "EPSG:3857": (-20037508.342789244, -20037508.342789244, 20037508.342789244, 20037508.342789244)}


def reproject(g: Geometry, source: str, target: str) -> Geometry:
    """Identity, or between EPSG:4326 and EPSG:3857; other systems raise."""
    if source == target:
        return g
    if source not in SYSTEMS or target not in SYSTEMS:
        raise ValueError(f"no transform from {source} to {target}")

    def move(c: np.ndarray) -> np.ndarray:
        x, y = np.asarray(c, dtype=float).reshape(-1, 2).T
        if target == "EPSG:3857":
            return np.stack([np.radians(x) * RADIUS, np.log(np.tan(np.pi / 4 + np.radians(y) / 2)) * RADIUS], axis=1)
        return np.stack([np.degrees(x / RADIUS), np.degrees(2 * np.arctan(np.exp(y / RADIUS)) - np.pi / 2)], axis=1)

    if g.parts:
        return _joined(g.kind, [reproject(p, source, target) for p in g.parts])
    return Geometry(g.kind, move(g.points), [move(x) for x in g.lines], [[move(r) for r in p] for p in g.polygons])


def nth_in(partition: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(order))
