"""Plane and earth geometry as column expressions.

A stored geometry is a struct: a point ``{x, y}`` or ``{latitude, longitude}``, a
box ``{min_x, min_y, max_x, max_y}``, or the general ``{kind, x, y, r, min_x,
min_y, max_x, max_y, ring}``. Predicates test bounding boxes first and then
exactly for the pairs named below; other pairs go by their boxes alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_METERS = 6_371_008.8
_NUMERIC = (T.DoubleType, T.LongType, T.IntegerType, T.FloatType, T.ShortType, T.ByteType, T.DecimalType)


@dataclass(frozen=True)
class Geometry:
    """A literal geometry."""

    kind: str  # point, circle, polygon, envelope, geo
    x: float = 0.0
    y: float = 0.0
    r: float = 0.0
    box: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    ring: tuple[tuple[float, float], ...] = ()

    @staticmethod
    def point(x: float, y: float) -> Geometry:
        return Geometry("point", x, y, box=(x, y, x, y))

    @staticmethod
    def circle(x: float, y: float, r: float) -> Geometry:
        return Geometry("circle", x, y, r, (x - r, y - r, x + r, y + r))

    @staticmethod
    def envelope(min_x: float, min_y: float, max_x: float, max_y: float) -> Geometry:
        return Geometry("envelope", box=(min_x, min_y, max_x, max_y))

    @staticmethod
    def polygon(ring: list[tuple[float, float]]) -> Geometry:
        xs, ys = [p[0] for p in ring] or [0.0], [p[1] for p in ring] or [0.0]
        return Geometry("polygon", box=(min(xs), min(ys), max(xs), max(ys)), ring=tuple(map(tuple, ring)))

    @staticmethod
    def geo(lat: float, lon: float, meters: float = 0.0) -> Geometry:
        """A place on earth and a distance in meters."""
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise ValueError(f"not a place on earth: latitude {lat}, longitude {lon}")
        return Geometry("geo", lon, lat, meters)


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Meters between two places; each argument a column or a number."""
    lat1, lon1, lat2, lon2 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lat1, lon1, lat2, lon2))
    a, b = F.radians(lat1), F.radians(lat2)
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(a) * F.cos(b) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_METERS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_ring(x: Column, y: Column, ring: tuple[tuple[float, float], ...]) -> Column:
    """Even-odd ray cast against a literal ring, one term an edge."""
    if len(ring) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        if yi == yj:
            continue  # a level edge is never crossed
        crosses = ((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < F.lit(xj - xi) * (y - F.lit(yi)) / F.lit(yj - yi) + F.lit(xi))
        crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def in_ring_column(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast against a ring column, an array of ``{x, y}``."""

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
        level = p["y"] == q["y"]
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(level, F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"]
        return ~level & ((p["y"] > y) != (q["y"] > y)) & (x < at)

    odd = F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(False), lambda acc, i: acc != F.coalesce(crosses(i), F.lit(False)))
    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(odd)


def segments_intersect(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether the segments a-b and c-d share a point."""

    def turn(p, q, r) -> Column:
        return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    def on(p, q, r) -> Column:
        return (r[0] <= F.greatest(p[0], q[0])) & (r[0] >= F.least(p[0], q[0])) & (r[1] <= F.greatest(p[1], q[1])) & (r[1] >= F.least(p[1], q[1]))

    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    cross = (t1 != t2) & (t3 != t4)
    return cross | ((t1 == 0) & on(a, b, c)) | ((t2 == 0) & on(a, b, d)) | ((t3 == 0) & on(c, d, a)) | ((t4 == 0) & on(c, d, b))


def line_length(line: Column) -> Column:
    """Length of an array of ``{x, y}``."""
    step = lambda i: distance(F.get(line, i)["x"], F.get(line, i)["y"], F.get(line, i + 1)["x"], F.get(line, i + 1)["y"])
    total = F.aggregate(F.sequence(F.lit(0), F.size(line) - 2), F.lit(0.0), lambda acc, i: acc + step(i))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(total)


def line_is_closed(line: Column) -> Column:
    first, last = F.get(line, F.lit(0)), F.get(line, F.size(line) - 1)
    return (F.size(line) > 2) & (first["x"] == last["x"]) & (first["y"] == last["y"])


def lines_intersect(a: Column, b: Column) -> Column:
    """Whether two arrays of ``{x, y}`` have segments that meet."""

    def at(line: Column, i: Column) -> tuple[Column, Column]:
        return F.get(line, i)["x"], F.get(line, i)["y"]

    def meets(i: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(b) - 2), lambda j: segments_intersect(at(a, i), at(a, i + 1), at(b, j), at(b, j + 1)))

    return F.when((F.size(a) < 2) | (F.size(b) < 2), F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), F.size(a) - 2), meets))


def with_holes_contains(x: Column, y: Column, exterior: Column, holes: Column) -> Column:
    """In the exterior ring and in none of the holes."""
    return in_ring_column(x, y, exterior) & ~F.coalesce(F.exists(holes, lambda h: in_ring_column(x, y, h)), F.lit(False))


def rings_are_closed(exterior: Column, holes: Column) -> Column:
    """Whether all rings have points and end where they begin: what makes a polygon valid."""
    closed = lambda ring: (F.size(ring) > 0) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return closed(exterior) & F.forall(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), closed)


def bounds(points: Column) -> Column:
    """The box of an array of ``{x, y}``; all zero if there are none."""
    pick = lambda f, c: F.coalesce(f(F.transform(points, lambda p: p[c])), F.lit(0.0))
    return F.struct(pick(F.array_min, "x").alias("min_x"), pick(F.array_min, "y").alias("min_y"), pick(F.array_max, "x").alias("max_x"), pick(F.array_max, "y").alias("max_y"))


class Box:
    """Operations on boxes ``{min_x, min_y, max_x, max_y}``; intervals are closed."""

    @staticmethod
    def width(b: Column) -> Column:
        return b["max_x"] - b["min_x"]

    @staticmethod
    def height(b: Column) -> Column:
        return b["max_y"] - b["min_y"]

    @staticmethod
    def area(b: Column) -> Column:
        return Box.width(b) * Box.height(b)

    @staticmethod
    def center(b: Column) -> Column:
        return F.struct(((b["min_x"] + b["max_x"]) / 2).alias("x"), ((b["min_y"] + b["max_y"]) / 2).alias("y"))

    @staticmethod
    def contains_point(b: Column, x: Column, y: Column) -> Column:
        return x.between(b["min_x"], b["max_x"]) & y.between(b["min_y"], b["max_y"])

    @staticmethod
    def contains(a: Column, b: Column) -> Column:
        return (b["min_x"] >= a["min_x"]) & (b["max_x"] <= a["max_x"]) & (b["min_y"] >= a["min_y"]) & (b["max_y"] <= a["max_y"])

    @staticmethod
    def intersects(a: Column, b: Column) -> Column:
        return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])

    @staticmethod
    def union(a: Column, b: Column) -> Column:
        return F.struct(F.least(a["min_x"], b["min_x"]).alias("min_x"), F.least(a["min_y"], b["min_y"]).alias("min_y"), F.greatest(a["max_x"], b["max_x"]).alias("max_x"), F.greatest(a["max_y"], b["max_y"]).alias("max_y"))

    @staticmethod
    def intersection(a: Column, b: Column) -> Column:
        both = F.struct(F.greatest(a["min_x"], b["min_x"]).alias("min_x"), F.greatest(a["min_y"], b["min_y"]).alias("min_y"), F.least(a["max_x"], b["max_x"]).alias("max_x"), F.least(a["max_y"], b["max_y"]).alias("max_y"))
        return F.when(Box.intersects(a, b), both)

    @staticmethod
    def is_point(b: Column) -> Column:
        return (b["min_x"] == b["max_x"]) & (b["min_y"] == b["max_y"])

    @staticmethod
    def is_valid(b: Column) -> Column:
        return (b["min_x"] <= b["max_x"]) & (b["min_y"] <= b["max_y"])


@dataclass(frozen=True)
class Stored:
    """A stored geometry's columns; `kind` is a column, or a string if all rows are alike."""

    kind: Column | str
    x: Column
    y: Column
    r: Column
    min_x: Column
    min_y: Column
    max_x: Column
    max_y: Column
    ring: Column | None = None

    @staticmethod
    def of(column: Column, kind: T.DataType) -> Stored | None:
        """The geometry in a struct column; None if its fields aren't a geometry's."""
        if not isinstance(kind, T.StructType):
            return None
        numeric = {f.name for f in kind.fields if isinstance(f.dataType, _NUMERIC)}
        get = lambda name: column.getField(name).cast("double")
        zero = F.lit(0.0)
        if "kind" in kind.names:
            return Stored(column.getField("kind"), *[get(n) if n in numeric else zero for n in ("x", "y", "r", "min_x", "min_y", "max_x", "max_y")], column.getField("ring") if "ring" in kind.names else None)
        if {"x", "y"} <= numeric:
            x, y = get("x"), get("y")
        elif {"latitude", "longitude"} <= numeric:
            x, y = get("longitude"), get("latitude")
        elif {"min_x", "min_y", "max_x", "max_y"} <= numeric:
            return Stored("envelope", zero, zero, zero, *[get(n) for n in ("min_x", "min_y", "max_x", "max_y")])
        else:
            return None
        return Stored("point", x, y, zero, x, y, x, y)

    def _by_kind(self, rules: dict[str, Column], other: Column) -> Column:
        if isinstance(self.kind, str):
            return rules.get(self.kind, other)
        out = None
        for name, rule in rules.items():
            out = F.when(self.kind == name, rule) if out is None else out.when(self.kind == name, rule)
        return other if out is None else out.otherwise(other)

    def intersects(self, g: Geometry) -> Column:
        lo_x, lo_y, hi_x, hi_y = g.box
        boxes = (self.min_x <= hi_x) & (self.max_x >= lo_x) & (self.min_y <= hi_y) & (self.max_y >= lo_y)
        center = distance(self.x, self.y, F.lit(g.x), F.lit(g.y))
        rules: dict[str, Column] = {}
        if g.kind == "point":
            rules = {"point": (self.x == g.x) & (self.y == g.y), "circle": center <= self.r, "envelope": F.lit(True)}
            if self.ring is not None:
                rules["polygon"] = in_ring_column(F.lit(g.x), F.lit(g.y), self.ring)
        elif g.kind == "circle":
            near_x, near_y = F.greatest(self.min_x, F.least(self.max_x, F.lit(g.x))), F.greatest(self.min_y, F.least(self.max_y, F.lit(g.y)))
            rules = {"point": center <= g.r, "circle": center <= self.r + g.r, "envelope": distance(near_x, near_y, F.lit(g.x), F.lit(g.y)) <= g.r}
        elif g.kind == "polygon":
            rules = {"point": in_ring(self.x, self.y, g.ring)}
        elif g.kind == "envelope":
            near_x, near_y = F.greatest(F.lit(lo_x), F.least(F.lit(hi_x), self.x)), F.greatest(F.lit(lo_y), F.least(F.lit(hi_y), self.y))
            rules = {"circle": distance(near_x, near_y, self.x, self.y) <= self.r}
        return boxes & self._by_kind(rules, F.lit(True))

    def within(self, g: Geometry) -> Column:
        lo_x, lo_y, hi_x, hi_y = g.box
        boxes = (self.min_x >= lo_x) & (self.max_x <= hi_x) & (self.min_y >= lo_y) & (self.max_y <= hi_y)
        center = distance(self.x, self.y, F.lit(g.x), F.lit(g.y))
        rules: dict[str, Column] = {}
        if g.kind == "circle":
            rules = {"point": boxes & (center <= g.r), "circle": center + self.r <= g.r}
        elif g.kind == "polygon":
            rules = {"point": boxes & in_ring(self.x, self.y, g.ring)}
        return self._by_kind(rules, boxes)

    def near(self, g: Geometry) -> Column:
        """At most the circle's radius away: exactly for points, by containment or intersection for others."""
        box = (self.min_x <= g.box[2]) & (self.max_x >= g.box[0]) & (self.min_y <= g.box[3]) & (self.max_y >= g.box[1])
        return box & self._by_kind({"point": distance(self.x, self.y, F.lit(g.x), F.lit(g.y)) <= g.r}, self.within(g) | self.intersects(g))

    def geo_near(self, g: Geometry) -> Column:
        """Points by great-circle distance; others if a circle of as many degrees holds their box."""
        valid = self.y.between(-90, 90) & self.x.between(-180, 180)
        # A band of latitude that holds the circle reaches the scan as a range.
        band = math.degrees(g.r / EARTH_METERS) * 1.000001 + 1e-9
        close = self.y.between(g.y - band, g.y + band) & (haversine(self.y, self.x, g.y, g.x) <= g.r)
        per_degree = 111_320.0 * (1 + math.cos(math.radians(g.y))) / 2
        r = g.r / (per_degree if per_degree > 0 else 111_320.0)
        boxes = (self.min_x >= g.x - r) & (self.max_x <= g.x + r) & (self.min_y >= g.y - r) & (self.max_y <= g.y + r)
        return self._by_kind({"point": valid & close}, boxes)

    def box_distance(self, x: float, y: float) -> Column:
        """From a point to the box; null without one, which `greatest` would pass over."""
        dx = F.greatest(self.min_x - x, F.lit(0.0), F.lit(x) - self.max_x)
        dy = F.greatest(self.min_y - y, F.lit(0.0), F.lit(y) - self.max_y)
        return F.when(self.min_x.isNotNull() & self.min_y.isNotNull(), F.sqrt(dx * dx + dy * dy))


def hilbert_index(x: Column, y: Column, bounds_: tuple[float, float, float, float], order: int = 16) -> Column:
    """The place on a Hilbert curve of `order` levels over a box: a key to lay files out by."""
    n = (1 << order) - 1
    scale = lambda v, lo, hi: F.least(F.lit(n), F.greatest(F.lit(0), F.floor((v - lo) / ((hi - lo) or 1.0) * n))).cast("long")
    start = F.struct(scale(x, bounds_[0], bounds_[2]).alias("x"), scale(y, bounds_[1], bounds_[3]).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, level: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        rx = (acc["x"].bitwiseAND(s) > 0).cast("long")
        ry = (acc["y"].bitwiseAND(s) > 0).cast("long")
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, F.lit(n) - acc["x"]).otherwise(acc["x"])
        fy = F.when(flip, F.lit(n) - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0)), start, step, lambda acc: acc["d"])
