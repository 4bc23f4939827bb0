"""Planar geometry on Columns: a ring is a closed array of struct(x, y), a line an open one. Everything stays in the JVM but the two kernels at the end."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*corners: tuple[Column, Column]) -> Column:
    """A closed ring through the corners."""
    return F.array(*[point(x, y) for x, y in (*corners, corners[0])])


def box_ring(minx, miny, maxx, maxy) -> Column:
    return ring((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy))


def pairs(line: Column, f) -> Column:
    """f(a, b) of every two neighbouring points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), f)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def area(r: Column) -> Column:
    """Signed shoelace area; counter-clockwise is positive."""
    return total(pairs(r, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def area_with_holes(shell: Column, holes: Column) -> Column:
    return F.abs(area(shell)) - F.aggregate(holes, F.lit(0.0), lambda s, h: s + F.abs(area(h)))


def length(line: Column) -> Column:
    return total(pairs(line, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def bbox(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def coordinate(name: str):
    return lambda p: p[name]


def vertex_centroid(r: Column) -> tuple[Column, Column]:
    """Mean of a ring's corners, the closing one left out."""
    open_ = F.slice(r, 1, F.size(r) - 1)
    return tuple(total(F.transform(open_, coordinate(c))) / F.size(open_) for c in "xy")


def area_centroid(r: Column) -> tuple[Column, Column]:
    def moment(c: str):
        return lambda a, b: (a[c] + b[c]) * (a["x"] * b["y"] - b["x"] * a["y"])

    return tuple(total(pairs(r, moment(c))) / (6 * area(r)) for c in "xy")


def regular(x, y, radius, sides: int, inner=None) -> Column:
    """A closed regular polygon, or with `inner` a star whose corners alternate between both radii."""
    n = sides * (2 if inner is not None else 1)
    r = lambda k: radius if inner is None else F.when(k % 2 == 0, radius).otherwise(inner)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: point(x + r(k % n) * F.cos(2 * math.pi * (k % n) / n), y + r(k % n) * F.sin(2 * math.pi * (k % n) / n)))


def ellipse(x, y, rx, ry, sides: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(sides)), lambda k: point(x + rx * F.cos(2 * math.pi * (k % sides) / sides), y + ry * F.sin(2 * math.pi * (k % sides) / sides)))


def inside(x: Column, y: Column, r: Column) -> Column:
    """Even-odd ray test with the half-open rule on y."""
    def cross(a, b):
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return F.when((a["y"] > y) != (b["y"] > y), (x < at).cast("int")).otherwise(0)

    return F.aggregate(pairs(r, cross), F.lit(0), lambda s, v: s + v) % 2 == 1


def half_plane(r: Column, nx, ny, c) -> Column:
    """The part of a ring where nx * x + ny * y <= c (Sutherland and Hodgman), closed again; empty if there is none."""
    side = lambda p: nx * p["x"] + ny * p["y"] - c

    def step(a, b):
        s, t = side(a), side(b)
        u = s / F.when(s == t, 1.0).otherwise(s - t)
        cut = point(a["x"] + u * (b["x"] - a["x"]), a["y"] + u * (b["y"] - a["y"]))
        return F.when((s <= 0) & (t <= 0), F.array(b)).when((s > 0) & (t > 0), F.slice(F.array(b), 1, 0)).when(s <= 0, F.array(cut)).otherwise(F.array(cut, b))

    # one lambda variable for what is named three times
    return F.get(F.transform(F.array(F.flatten(pairs(r, step))), lambda o: F.concat(o, F.slice(o, 1, 1))), F.lit(0))


def clip_to_box(r: Column, minx, miny, maxx, maxy) -> Column:
    """The part of a ring in a box, by one half plane after another; exact for convex rings, and in area for all."""
    plane = lambda nx, ny, c: F.struct(F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), c.cast("double").alias("c"))
    planes = F.array(plane(-1.0, 0.0, -minx), plane(1.0, 0.0, maxx), plane(0.0, -1.0, -miny), plane(0.0, 1.0, maxy))
    return F.aggregate(planes, r, lambda s, p: F.when(F.size(s) < 4, s).otherwise(half_plane(s, p["nx"], p["ny"], p["c"])))


def chaikin(line: Column) -> Column:
    """One round of corner cutting of an open line; its ends stay."""
    mid = F.flatten(pairs(line, lambda a, b: F.array(*[point(a["x"] * (1 - w) + b["x"] * w, a["y"] * (1 - w) + b["y"] * w) for w in (0.25, 0.75)])))
    return F.concat(F.slice(line, 1, 1), mid, F.slice(line, -1, 1))


def moving_average(line: Column, half: int) -> Column:
    """Each inner point becomes the mean of the points up to `half` places off; the ends stay."""
    n = F.size(line)

    def mean(p, k):
        near = F.slice(line, F.greatest(F.lit(1), k + 1 - half), F.least(n, k + 1 + half) - F.greatest(F.lit(1), k + 1 - half) + 1)
        return F.when((k == 0) | (k == n - 1), p).otherwise(point(*[total(F.transform(near, coordinate(c))) / F.size(near) for c in "xy"]))

    return F.transform(line, mean)


def densify(line: Column, most) -> Column:
    """Points added so that no segment is longer than `most`; a segment is cut into equal parts. Lengths are roots of sums of squares, as in SQL: `hypot` differs in the last digit, which tells where `most` goes into a length without rest."""
    def cut(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / most).cast("int"))
        # the argument of a lambda is worked out once
        return F.flatten(F.transform(F.array(n), lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: point(a["x"] + (b["x"] - a["x"]) * k / n, a["y"] + (b["y"] - a["y"]) * k / n))))

    return F.concat(F.slice(line, 1, 1), F.flatten(pairs(line, cut)))


def thinned(line: Column, least) -> Column:
    """Radial simplification: a point goes if it is nearer than `least` to the last one kept; the last point stays."""
    first, last = F.slice(line, 1, 1), F.slice(line, -1, 1)
    inner = F.slice(line, 2, F.greatest(F.size(line) - 2, F.lit(0)))
    far = lambda s, p: F.hypot(p["x"] - F.element_at(s, -1)["x"], p["y"] - F.element_at(s, -1)["y"]) >= least
    return F.concat(F.aggregate(inner, first, lambda s, p: F.when(far(s, p), F.concat(s, F.array(p))).otherwise(s)), last)


def segment_crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """struct(x, y) where two segments cross, ends included; null if they do not or are parallel."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), den)
    u = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), den)
    return F.when(t.between(0, 1) & u.between(0, 1), point(ax + t * (bx - ax), ay + t * (by - ay)))


def nearest_on(line: Column, px, py) -> Column:
    """struct(distance, x, y) of the point of a line or ring nearest to a point."""
    def near(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        x, y = a["x"] + t * dx, a["y"] + t * dy
        return F.struct(F.hypot(px - x, py - y).alias("distance"), x.alias("x"), y.alias("y"))

    return F.array_min(pairs(line, near))


def without_repeats(line: Column) -> Column:
    """Without points equal to their predecessor."""
    return F.concat(F.slice(line, 1, 1), F.filter(pairs(line, lambda a, b: F.when((a["x"] != b["x"]) | (a["y"] != b["y"]), b)), lambda p: p.isNotNull()))


def issues(r: Column) -> Column:
    """Names of what is wrong with a ring: not_closed, too_few_points, repeated_point, clockwise, out_of_range, spike."""
    first, last = F.get(r, F.lit(0)), F.element_at(r, -1)
    back = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    n = F.size(r)
    spike = F.exists(F.zip_with(F.slice(r, 1, F.greatest(n - 2, F.lit(0))), F.slice(r, 3, F.greatest(n - 2, F.lit(0))), back), lambda v: F.coalesce(v, F.lit(False)))
    rules = {
        "not_closed": ~back(first, last), "too_few_points": n < 4, "repeated_point": F.exists(pairs(r, back), lambda v: v), "clockwise": area(F.concat(r, F.slice(r, 1, 1))) < 0,
        "out_of_range": F.exists(r, lambda p: (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90)), "spike": spike & (n > 4),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def repaired(r: Column) -> Column:
    """Closed, without repeated points, counter-clockwise."""
    first, last = F.get(r, F.lit(0)), F.element_at(r, -1)
    closed = F.when((first["x"] != last["x"]) | (first["y"] != last["y"]), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    clean = without_repeats(closed)
    return F.when(area(clean) < 0, F.reverse(clean)).otherwise(clean)


def to_wkt(r: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(r, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit("))"))


def from_wkt(text: Column) -> Column:
    """The outer ring of a POLYGON, the points of a LINESTRING or the one of a POINT."""
    numbers = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    return F.transform(F.split(numbers, r",\s*"), lambda p: point(F.element_at(F.split(F.trim(p), r"\s+"), 1), F.element_at(F.split(F.trim(p), r"\s+"), 2)))


def to_geojson(r: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def from_geojson(text: Column) -> Column:
    return F.transform(F.get(F.from_json(text, "type string, coordinates array<array<array<double>>>")["coordinates"], F.lit(0)), lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by the monotone chain, closed and counter-clockwise."""
    todo = sorted(set(points))
    if len(todo) < 3:
        return todo + todo[:1]

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ends = half(todo) + half(todo[::-1])
    return ends + ends[:1]


def far_points(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Line simplification: a stretch whose points all lie within `tolerance` of its chord becomes the chord, else it is cut at the farthest."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        size = math.hypot(bx - ax, by - ay)
        off = [(abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / size if size else math.hypot(x - ax, y - ay), k) for k, (x, y) in enumerate(line[a + 1 : b], a + 1)]
        if off and max(off)[0] > tolerance:
            k = max(off)[1]
            keep.add(k)
            todo += [(a, k), (k, b)]
    return [line[k] for k in sorted(keep)]


def on_lines(f):
    """A pandas UDF over columns of lines, for what has no fixed number of steps; `f` takes and gives a list of (x, y)."""
    @F.pandas_udf(RING)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else [{"x": x, "y": y} for x, y in f([(p["x"], p["y"]) for p in line])])

    return run
