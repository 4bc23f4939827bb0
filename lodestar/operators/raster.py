"""Pixel tables (by..., r, c, bands) and elevation models (r, c, value): bands as Columns, neighbourhoods as equi joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import durable
from .graph import components
from .spatial import neighbours8

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0."""
    return F.when(a + b == 0, 0.0).otherwise((a - b) / F.when(a + b == 0, 1.0).otherwise(a + b))


def reclassify(value: Column, classes: list[tuple[float, float, float]], other: float | None = None) -> Column:
    """The new value of the first range (low, high, new) with low <= value < high."""
    out = F.lit(other)
    for lo, hi, new in reversed(classes):
        out = F.when((value >= lo) & (value < hi), F.lit(new)).otherwise(out)
    return out


def window_of(n: DataFrame) -> list[Column]:
    return [F.col(f"`n_{i}_{j}`") for i, j in AROUND]


def focal(cells: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., r, c, mean, total, least, most, sd, median) of the 3 by 3 cells round each, cut at the edges."""
    n = neighbours8(cells, value, by)
    all_ = F.array_compact(F.array(*window_of(n)))
    n = n.withColumn("a", F.array_sort(all_))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)
    k = F.size("a")
    return n.select(*by, "r", "c", (total / k).alias("mean"), total.alias("total"), F.array_min("a").alias("least"), F.array_max("a").alias("most"), F.sqrt(F.greatest(F.lit(0.0), squares / k - F.pow(total / k, F.lit(2)))).alias("sd"), F.get("a", F.floor(k / 2).cast("int")).alias("median"))


def whole_windows(dem: DataFrame, value: str) -> tuple[DataFrame, dict]:
    """Cells with all eight neighbours, and the Columns of the window by offset."""
    n = neighbours8(dem, value)
    v = dict(zip(AROUND, window_of(n)))
    full = None
    for x in v.values():
        full = x.isNotNull() if full is None else full & x.isNotNull()
    return n.where(full), v


def hillshade(slope: Column, aspect: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """0 to 255 from slope and aspect in degrees."""
    z, a = math.radians(90 - altitude), math.radians(360 - azimuth + 90)
    s, t = F.radians(slope), F.radians(aspect)
    return F.greatest(F.lit(0.0), 255 * (math.cos(z) * F.cos(s) + math.sin(z) * F.sin(s) * F.cos(a - t)))


def curvature(dem: DataFrame, value: str, cell: float = 1.0) -> DataFrame:
    """(r, c, curvature): minus twice the second derivatives' sum, times 100; only cells with four neighbours beside them."""
    n = neighbours8(dem, value)
    v = dict(zip(AROUND, window_of(n)))
    d = ((v[0, -1] + v[0, 1]) / 2 - v[0, 0]) / cell**2
    e = ((v[-1, 0] + v[1, 0]) / 2 - v[0, 0]) / cell**2
    return n.select("r", "c", (-2 * (d + e) * 100).alias("curvature")).where("curvature IS NOT NULL")


#: The code of each direction of flow.
FLOW = {(0, 1): 1, (1, 1): 2, (1, 0): 4, (1, -1): 8, (0, -1): 16, (-1, -1): 32, (-1, 0): 64, (-1, 1): 128}


def flow_direction(dem: DataFrame, value: str) -> DataFrame:
    """(r, c, code, dr, dc) of the steepest way down from each cell, ties to the smaller code; code 0 in pits."""
    n = neighbours8(dem, value)
    v = dict(zip(AROUND, window_of(n)))
    drop = F.array_compact(F.array(*[F.when(v[o] < v[0, 0], F.struct((-(v[0, 0] - v[o]) / math.hypot(*o)).alias("down"), F.lit(code).alias("code"), F.lit(o[0]).alias("dr"), F.lit(o[1]).alias("dc"))) for o, code in FLOW.items()]))
    best = F.array_min(drop)
    return n.select("r", "c", F.coalesce(best["code"], F.lit(0)).alias("code"), F.coalesce(best["dr"], F.lit(0)).alias("dr"), F.coalesce(best["dc"], F.lit(0)).alias("dc"))


def flow_accumulation(flow: DataFrame, rounds: int = 64) -> DataFrame:
    """(r, c, upstream): how many cells drain through each.

    Pointers double: after k rounds each cell points 2**k cells down its way and has counted what lies less than 2**k cells up from it, so the longest
    way of n cells takes log n rounds of one join and one aggregation. Cells that flow out of the table end their way there.
    """
    cells = flow.select("r", "c")
    down = flow.where("dr <> 0 OR dc <> 0").select("r", "c", (F.col("r") + F.col("dr")).alias("tr"), (F.col("c") + F.col("dc")).alias("tc"))
    jump = down.join(cells.select(F.col("r").alias("tr"), F.col("c").alias("tc")), ["tr", "tc"], "left_semi").select("r", "c", "tr", "tc")
    state = durable(cells.join(jump, ["r", "c"], "left").withColumn("n", F.lit(1).cast("long")))
    for _ in range(rounds):
        arrived = state.where("tr IS NOT NULL").groupBy(F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.sum("n").alias("more"))
        on = state.select(F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("tr").alias("ur"), F.col("tc").alias("uc"))
        moved = state.join(arrived, ["r", "c"], "left").join(on, ["tr", "tc"], "left")
        state = durable(moved.select("r", "c", F.col("ur").alias("tr"), F.col("uc").alias("tc"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        if state.where("tr IS NOT NULL").isEmpty():
            return state.select("r", "c", (F.col("n") - 1).alias("upstream"))
    raise RuntimeError(f"water was still moving after {rounds} rounds")


def six_s(band: Column, path: float, down: float, up: float) -> Column:
    """Surface reflectance: less the path radiance, over both transmittances, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (band - path) / (down * up)))


# How much aerosol scatters, by surroundings.
AEROSOL = {"rural": 1.0, "maritime": 0.8, "urban": 1.3}


def flaash(band: Column, wavelength: float, visibility: float, aerosol: str = "rural") -> Column:
    """Reflectance corrected by scattering of air and aerosol at a wavelength (micrometres) and visibility (km); a tenth of it is absorbed."""
    scattering = 0.008735 * wavelength**-4.08 + 3.91 / visibility * AEROSOL[aerosol] * wavelength**-1.3
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (band - 0.1 * scattering) / (1 + scattering)))


def sunlit(dem: DataFrame, value: str, zenith: float, azimuth: float) -> DataFrame:
    """(r, c, factor) by which a band is multiplied to take out slopes: the cosine of the zenith over that of the incidence, 1 where the sun does not reach; only cells with all four sides."""
    n = neighbours8(dem, value)
    v = {(i, j): F.col(f"`n_{i}_{j}`") for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))}
    dx, dy = (v[0, 1] - v[0, -1]) / 2, (v[1, 0] - v[-1, 0]) / 2
    slope, aspect = F.atan(F.sqrt(dx * dx + dy * dy)), F.atan2(dy, dx)
    z, a = math.radians(zenith), math.radians(azimuth)
    incidence = math.cos(z) * F.cos(slope) + math.sin(z) * F.sin(slope) * F.cos(F.lit(a) - aspect)
    return n.where(dx.isNotNull() & dy.isNotNull()).select("r", "c", F.when(incidence > 0, math.cos(z) / incidence).otherwise(1.0).alias("factor"))


def high_pass(pixels: DataFrame, pan: str, by: list[str]) -> DataFrame:
    """(by.., r, c, detail): a panchromatic band less the mean of the 3 by 3 cells round each that are there."""
    n = neighbours8(pixels, pan, by)
    near = F.array_compact(F.array(*window_of(n)))
    mean = F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.size(near)
    return n.select(*by, "r", "c", (F.col("n_0_0") - mean).alias("detail"))


def contour_segments(dem: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """(level, r, c, x1, y1, x2, y2): segments of iso-lines in each square of four cells by marching squares, points linear on the edges.

    A saddle is split by the mean of its corners.
    """
    n = neighbours8(dem, value)
    v = dict(zip(AROUND, window_of(n)))
    a, b, e, d = v[0, 0], v[0, 1], v[1, 1], v[1, 0]
    q = n.where(b.isNotNull() & e.isNotNull() & d.isNotNull()).select("r", "c", a.alias("a"), b.alias("b"), e.alias("e"), d.alias("d"), F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    at = lambda p, s: F.try_divide(F.col("level") - F.col(p), F.col(s) - F.col(p))
    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    pt = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    edge = {"top": pt(x + at("a", "b"), y), "right": pt(x + 1, y + at("b", "e")), "bottom": pt(x + at("d", "e"), y + 1), "left": pt(x, y + at("a", "d"))}
    code = sum(((F.col(k) >= F.col("level")).cast("int") * w for k, w in (("a", 8), ("b", 4), ("e", 2), ("d", 1))), F.lit(0))
    high = (F.col("a") + F.col("b") + F.col("e") + F.col("d")) / 4 >= F.col("level")
    seg = lambda p, s: F.struct(edge[p].alias("p"), edge[s].alias("q"))
    lines = {1: ("left", "bottom"), 2: ("bottom", "right"), 3: ("left", "right"), 4: ("top", "right"), 6: ("top", "bottom"), 7: ("left", "top"), 8: ("left", "top"), 9: ("top", "bottom"), 11: ("top", "right"), 12: ("left", "right"), 13: ("bottom", "right"), 14: ("left", "bottom")}
    two = lambda p, s: F.array(seg(*p), seg(*s))
    out = F.when(F.col("k") == 5, F.when(high, two(("left", "top"), ("bottom", "right"))).otherwise(two(("left", "bottom"), ("top", "right"))))
    out = out.when(F.col("k") == 10, F.when(high, two(("left", "bottom"), ("top", "right"))).otherwise(two(("left", "top"), ("bottom", "right"))))
    for k, (p, s) in lines.items():
        out = out.when(F.col("k") == k, F.array(seg(p, s)))
    return q.withColumn("k", code).where("k > 0 AND k < 15").select("level", "r", "c", F.explode(out).alias("s")).select("level", "r", "c", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def visible(dem: DataFrame, value: str, observer: tuple[int, int], height: float, radius: int) -> DataFrame:
    """(r, c, visible) of the cells within `radius` of an observer: no cell on the straight way stands above the line of sight."""
    r0, c0 = observer
    base = dem.where((F.col("r") == r0) & (F.col("c") == c0)).select(F.col(value)).first()
    if base is None:
        return dem.select("r", "c", F.lit(False).alias("visible")).limit(0)
    eye = float(base[0]) + height
    near = dem.where(F.col("r").between(r0 - radius, r0 + radius) & F.col("c").between(c0 - radius, c0 + radius)).select("r", "c", F.col(value).alias("z"))
    steps = F.greatest(F.abs(F.col("r") - r0), F.abs(F.col("c") - c0)).cast("int")
    ray = near.withColumn("n", steps).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    on = lambda a, o: F.floor(o + (F.col(a) - o) * F.col("k") / F.col("n") + 0.5).cast("long")
    ray = ray.select("r", "c", "n", "k", on("r", r0).alias("rr"), on("c", c0).alias("cc"))
    slope = (F.col("z") - eye) / F.col("k")
    seen = ray.join(near.select(F.col("r").alias("rr"), F.col("c").alias("cc"), "z"), ["rr", "cc"]).groupBy("r", "c").agg(F.max(F.when(F.col("k") < F.col("n"), slope)).alias("before"), F.max(F.when(F.col("k") == F.col("n"), slope)).alias("own"))
    return seen.select("r", "c", (F.col("before").isNull() | (F.col("own") >= F.col("before"))).alias("visible"))


def regions(cells: DataFrame, mask: Column) -> DataFrame:
    """(r, c, region) of the cells that `mask` holds for, joined with their four neighbours; a region has its least cell's number."""
    on = cells.where(mask).select("r", "c", (F.col("r") * (1 << 31) + F.col("c")).alias("node"))
    step = on.select("node", F.explode(F.array(F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c")), F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c")))).alias("s")).select(F.col("node").alias("src"), "s.r", "s.c")
    links = step.join(on.withColumnRenamed("node", "dst"), ["r", "c"]).select("src", "dst")
    return on.join(components(links, on.select("node")), "node").select("r", "c", F.col("component").alias("region"))


def nearest_class(pixels: DataFrame, training: DataFrame, bands: list[str], label: str, likelihood: bool = False) -> DataFrame:
    """`pixels` with the class of nearest mean, or of highest Gaussian likelihood with a variance per band; the classes' few statistics are literals.

    Ties go to the smaller label.
    """
    stats = training.groupBy(label).agg(*[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("m", F.avg), ("v", F.var_pop))]).orderBy(label).collect()

    def score(r):
        if likelihood:
            return sum((F.pow(F.col(b) - r[f"m_{b}"], F.lit(2)) / max(r[f"v_{b}"], 1e-9) + math.log(max(r[f"v_{b}"], 1e-9)) for b in bands), F.lit(0.0))
        return sum((F.pow(F.col(b) - r[f"m_{b}"], F.lit(2)) for b in bands), F.lit(0.0))

    return pixels.withColumn("class", F.array_min(F.array(*[F.struct(score(r).alias("d"), F.lit(r[label]).alias("k")) for r in stats]))["k"])
