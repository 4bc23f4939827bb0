"""Geodesy, tile arithmetic and planar geometry as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH, MERCATOR = 6_371_000.0, 6_378_137.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle azimuth in degrees, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return (F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360) % 360


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR), F.degrees(2 * F.atan(F.exp(y / MERCATOR)) - math.pi / 2)


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Tile x and y of a place, cut to the grid."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    cut = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(n - 1))).cast("long")
    return cut(x), cut(y)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    digits = [(F.shiftright(x, k).bitwiseAND(1) + 2 * F.shiftright(y, k).bitwiseAND(1)).cast("string") for k in reversed(range(zoom))]
    return F.concat(*digits) if digits else F.lit("")


def tile_bounds(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """min lon, min lat, max lon, max lat."""
    n = float(1 << zoom)
    lat = lambda t: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * t / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a closed ring, an array of struct(x, y); counter-clockwise is positive."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def path_length(line: Column) -> Column:
    pairs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray test with the half-open rule on y."""
    def cross(a, b):
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    hits = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.coalesce(cross(a, b), F.lit(False)).cast("int"))
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def circle(x: Column, y: Column, radius: Column, sides: int) -> Column:
    """A closed ring of `sides` corners round a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda k: F.struct((x + radius * F.cos(2 * math.pi * (k % sides) / sides)).alias("x"), (y + radius * F.sin(2 * math.pi * (k % sides) / sides)).alias("y")))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def destination(lon: Column, lat: Column, azimuth: Column, metres: Column) -> tuple[Column, Column]:
    """Where a great circle leads from a place after so many metres."""
    p, b, a = F.radians(lat), F.radians(azimuth), metres / EARTH
    q = F.asin(F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * F.cos(b))
    return lon + F.degrees(F.atan2(F.sin(b) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * F.sin(q))), F.degrees(q)


# The WGS84 ellipsoid.
AXIS, ECC2 = 6_378_137.0, 0.00669437999014


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(zone, easting, northing from the equator) by the transverse Mercator series."""
    zone = F.floor((lon + 180) / 6).cast("int") % 60 + 1
    p, e2 = F.radians(lat), ECC2 / (1 - ECC2)
    n = AXIS / F.sqrt(1 - ECC2 * F.pow(F.sin(p), F.lit(2)))
    t, k, a = F.pow(F.tan(p), F.lit(2)), e2 * F.pow(F.cos(p), F.lit(2)), F.cos(p) * F.radians(lon - (zone * 6 - 183))
    m = AXIS * (0.99832429843134 * p - 0.00251460707284 * F.sin(2 * p) + 0.00000263904662 * F.sin(4 * p) - 0.00000000341804 * F.sin(6 * p))
    up = lambda n_: F.pow(a, F.lit(n_))
    x = 500000 + 0.9996 * n * (a + (1 - t + k) * up(3) / 6 + (5 - 18 * t + t * t + 72 * k - 58 * e2) * up(5) / 120)
    y = 0.9996 * (m + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * k + 4 * k * k) * up(4) / 24 + (61 - 58 * t + t * t + 600 * k - 330 * e2) * up(6) / 720))
    return zone, x, y


def datum_shift(lon: Column, lat: Column, height: Column, move: tuple[float, float, float], turn: tuple[float, float, float], ppm: float, rounds: int = 5) -> tuple[Column, Column, Column]:
    """(lon, lat, height) after a seven-parameter shift: metres, arc seconds and parts per million; both datums on WGS84's ellipsoid."""
    p, q = F.radians(lat), F.radians(lon)
    n = AXIS / F.sqrt(1 - ECC2 * F.pow(F.sin(p), F.lit(2)))
    x, y, z = (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - ECC2) + height) * F.sin(p)
    rx, ry, rz = (math.radians(t / 3600) for t in turn)
    s = 1 + ppm / 1e6
    x, y, z = move[0] + s * x - rz * y + ry * z, move[1] + rz * x + s * y - rx * z, move[2] - ry * x + rx * y + s * z
    r = F.hypot(x, y)
    lat2 = F.atan2(z, r * (1 - ECC2))
    for _ in range(rounds):
        n = AXIS / F.sqrt(1 - ECC2 * F.pow(F.sin(lat2), F.lit(2)))
        lat2 = F.atan2(z + ECC2 * n * F.sin(lat2), r)
    n = AXIS / F.sqrt(1 - ECC2 * F.pow(F.sin(lat2), F.lit(2)))
    return F.degrees(F.atan2(y, x)), F.degrees(lat2), r / F.cos(lat2) - n
