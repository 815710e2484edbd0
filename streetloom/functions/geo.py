"""Planar geometry and map projections as column expressions over coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0


def swiss_to_wgs84(e: Column, n: Column) -> tuple[Column, Column]:
    """(lon, lat) by the published approximate formulas of the national survey, good to about a metre."""
    y, x = (e - 2600000.0) / 1000000.0, (n - 1200000.0) / 1000000.0
    lon = F.lit(2.6779094) + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = F.lit(16.9023892) + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lon * 100 / 36, lat * 100 / 36


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile."""
    n = float(1 << zoom)
    row = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n
    return F.floor((lon + 180) / 360 * n), F.floor(row)


def destination(lon: Column, lat: Column, bearing: float, metres: float) -> tuple[Column, Column]:
    """Where a great circle of that length ends (sphere of mean radius)."""
    d, b = metres / 6371008.8, math.radians(bearing)
    phi = F.radians(lat)
    phi2 = F.asin(F.sin(phi) * math.cos(d) + F.cos(phi) * math.sin(d) * math.cos(b))
    turn = F.atan2(F.lit(math.sin(b) * math.sin(d)) * F.cos(phi), F.lit(math.cos(d)) - F.sin(phi) * F.sin(phi2))
    return lon + F.degrees(turn), F.degrees(phi2)


def square(lon: Column, lat: Column, size_m: float) -> Column:
    """A closed ring of four corners at half the diagonal from the centre."""
    corners = [destination(lon, lat, b, size_m / 2 * 1.4142) for b in (45, 135, 225, 315)]
    points = [F.struct(x.alias("x"), y.alias("y")) for x, y in corners]
    return F.array(*points, points[0])


def mercator_square(lon: Column, lat: Column, size_m: float) -> Column:
    x, y = web_mercator(lon, lat)
    h = size_m / 2
    points = [F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((-h, -h), (h, -h), (h, h), (-h, h), (-h, -h))]
    return F.array(*points)


def pairs(points: Column) -> Column:
    """Consecutive points of a line."""
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def line_length(points: Column) -> Column:
    step = lambda s, p: s + F.sqrt((p["a"]["x"] - p["b"]["x"]) * (p["a"]["x"] - p["b"]["x"]) + (p["a"]["y"] - p["b"]["y"]) * (p["a"]["y"] - p["b"]["y"]))
    return F.aggregate(pairs(points), F.lit(0.0), step)


def ring_area(ring: Column) -> Column:
    """Shoelace formula over a closed ring."""
    return F.abs(F.aggregate(pairs(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    twice = F.aggregate(pairs(ring), F.lit(0.0), lambda s, p: s + cross(p))
    of = lambda c: F.aggregate(pairs(ring), F.lit(0.0), lambda s, p: s + (p["a"][c] + p["b"][c]) * cross(p)) / (3 * twice)
    return of("x"), of("y")


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a fixed polygon: the parity of edges crossed to its right."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (y - ay) * ((bx - ax) / (by - ay)) + ax)
            crossed = crossed + hit.cast("int")
    return crossed % 2 == 1


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def wkt_line(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def stitched(paths: Column) -> Column:
    """One line of several that meet: the joint is kept once."""
    return F.flatten(F.transform(paths, lambda p, i: F.when(i == 0, p).otherwise(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))))


def midpoint(points: Column) -> Column:
    """The point half way along a line."""
    half = line_length(points) / 2

    def walk(done: Column, p: Column) -> Column:
        dx, dy = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]
        step = F.sqrt(dx * dx + dy * dy)
        t = F.when(step > 0, (half - done["run"]) / step).otherwise(0.0)
        here = F.struct((p["a"]["x"] + t * dx).alias("x"), (p["a"]["y"] + t * dy).alias("y"))
        found = done["at"].isNull() & (done["run"] + step >= half)
        return F.struct((done["run"] + step).alias("run"), F.when(found, here).otherwise(done["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))
    return F.aggregate(pairs(points), start, walk, lambda done: F.coalesce(done["at"], points[0]))


def offset_line(points: Column, metres: float) -> Column:
    """Each segment moved to its right; degrees of 111 and 77 km."""
    sx, sy = 77000.0, 111000.0

    def moved(p: Column) -> Column:
        dx, dy = (p["b"]["x"] - p["a"]["x"]) * sx, (p["b"]["y"] - p["a"]["y"]) * sy
        n = F.sqrt(dx * dx + dy * dy)
        ox, oy = F.when(n > 0, dy / n * metres / sx).otherwise(0.0), F.when(n > 0, -dx / n * metres / sy).otherwise(0.0)
        return F.array(*[F.struct((q["x"] + ox).alias("x"), (q["y"] + oy).alias("y")) for q in (p["a"], p["b"])])

    return F.flatten(F.transform(pairs(points), moved))


def segments_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Between two segments (x1, y1, x2, y2): nothing if they cross, else from the nearest end."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    crossing = (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) < 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) < 0)
    ends = F.least(segment_distance(ax, ay, cx, cy, dx, dy), segment_distance(bx, by, cx, cy, dx, dy), segment_distance(cx, cy, ax, ay, bx, by), segment_distance(dx, dy, ax, ay, bx, by))
    return F.when(crossing, 0.0).otherwise(ends)


def cells_of(x1: Column, y1: Column, x2: Column, y2: Column, size: float, reach: float) -> Column:
    """The grid cells that a segment's box, grown by reach, touches: keys for an equi-join."""
    low = lambda p, q: F.floor((F.least(p, q) - reach) / size)
    high = lambda p, q: F.floor((F.greatest(p, q) + reach) / size)
    return F.flatten(F.transform(F.sequence(low(x1, x2), high(x1, x2)), lambda cx: F.transform(F.sequence(low(y1, y2), high(y1, y2)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
