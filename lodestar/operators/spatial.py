"""Spatial joins and statistics as equi joins on grid cells; networks as rounds of relaxation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of a point (id, lon, lat) and a box (box, minx, miny, maxx, maxy) that holds it, edges included.

    A box is listed under every cell it meets, a point under its own, so the join is an equi join and no pair appears twice.
    """
    spread = boxes.withColumn("cx", F.explode(F.sequence(_cell(F.col("minx"), size), _cell(F.col("maxx"), size)))).withColumn("cy", F.explode(F.sequence(_cell(F.col("miny"), size), _cell(F.col("maxy"), size))))
    keyed = points.withColumn("cx", _cell(F.col("lon"), size)).withColumn("cy", _cell(F.col("lat"), size))
    inside = F.col("lon").between(F.col("minx"), F.col("maxx")) & F.col("lat").between(F.col("miny"), F.col("maxy"))
    return keyed.join(spread, ["cx", "cy"]).where(inside).drop("cx", "cy")


def within_distance(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (id, lon, lat) of `a` and (id2, lon2, lat2) of `b` at a planar distance of `radius` or less: with the column distance.

    Cells have the size of the radius; `b` is listed in the nine cells round its own, which is too much to be broadcast even where its file is small.
    """
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = b.withColumn("ox", F.explode(near)).withColumn("oy", F.explode(near)).withColumn("cx", _cell(F.col("lon2"), radius) + F.col("ox")).withColumn("cy", _cell(F.col("lat2"), radius) + F.col("oy")).drop("ox", "oy")
    keyed = a.withColumn("cx", _cell(F.col("lon"), radius)).withColumn("cy", _cell(F.col("lat"), radius))
    dx, dy = F.col("lon") - F.col("lon2"), F.col("lat") - F.col("lat2")
    return keyed.join(spread.hint("merge"), ["cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= radius).drop("cx", "cy")


def nearest(a: DataFrame, b: DataFrame, k: int, radius: float, most: float = 720.0) -> DataFrame:
    """The k nearest points of `b` (id2, lon2, lat2) for each of `a` (id, lon, lat), ties to the smaller id2: with distance and rank.

    Nothing farther than `most` counts. The radius a point begins with, at most `radius`, follows the density of its surroundings (`nearest_adaptive`).
    """
    from .density import nearest_adaptive

    return nearest_adaptive(a, b, k, span=most, depth=max(16, math.ceil(math.log2(most / radius))))


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, rounds: int = 1000) -> DataFrame:
    """(origin, node, cost, path) of the cheapest paths from each `sources.origin` over directed edges (src, dst, cost >= 0).

    Every round extends only the nodes that got cheaper, for all origins in one join, and stops when none did; an error is raised
    if that takes more than `rounds`.
    """
    from ..checkpoint import durable

    # new names for the columns: frames that were cut from their lineage meet themselves in the joins below
    cut = lambda df: durable(df.select(*[F.col(c).alias(c) for c in ("origin", "node", "cost", "path")]))
    best = frontier = cut(sources.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.array("origin").alias("path")))
    for _ in range(rounds):
        steps = frontier.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.src")).select("origin", F.col("e.dst").alias("node"), (F.col("f.cost") + F.col("e.cost")).alias("cost"), F.concat("path", F.array("e.dst")).alias("path"))
        if cutoff is not None:
            steps = steps.where(F.col("cost") <= cutoff)
        step = steps.groupBy(F.col("origin").alias("o"), F.col("node").alias("n")).agg(F.min(F.struct("cost", "path")).alias("b"))
        old = best.select(F.col("origin").alias("o"), F.col("node").alias("n"), F.col("cost").alias("was"))
        better = cut(step.join(old, ["o", "n"], "left").where(F.col("was").isNull() | (F.col("b.cost") < F.col("was"))).select(F.col("o").alias("origin"), F.col("n").alias("node"), "b.cost", "b.path"))
        if better.isEmpty():
            return best
        gone = better.select(F.col("origin").alias("o"), F.col("node").alias("n"))
        best = cut(best.join(gone, (F.col("origin") == F.col("o")) & (F.col("node") == F.col("n")), "left_anti").unionByName(better))
        frontier = better
    raise RuntimeError(f"paths still became cheaper after {rounds} rounds")


def neighbours8(cells: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """`cells` (by..., r, c, value) with n_-1_-1 ... n_1_1, the values of the 3 by 3 cells round each; null outside.

    Each cell is sent to its nine places once and the places are put together by one aggregation.
    """
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = cells.select(*by, "r", "c", F.col(value).alias("_v"), shifts.alias("s")).select(*by, (F.col("r") - F.col("s.i")).alias("r"), (F.col("c") - F.col("s.j")).alias("c"), "_v", "s")
    put = [F.max(F.when((F.col("s.i") == i) & (F.col("s.j") == j), F.col("_v"))).alias(f"n_{i}_{j}") for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return sent.groupBy(*by, "r", "c").agg(*put).where(F.col("n_0_0").isNotNull())


def horn_slope(dem: DataFrame, value: str, cell: float = 1.0) -> DataFrame:
    """(r, c, slope, aspect) in degrees by Horn's weights; only cells with all eight neighbours."""
    n = neighbours8(dem, value)
    v = {(i, j): F.col(f"`n_{i}_{j}`") for i in (-1, 0, 1) for j in (-1, 0, 1)}
    dx = ((v[-1, 1] + 2 * v[0, 1] + v[1, 1]) - (v[-1, -1] + 2 * v[0, -1] + v[1, -1])) / (8 * cell)
    dy = ((v[1, -1] + 2 * v[1, 0] + v[1, 1]) - (v[-1, -1] + 2 * v[-1, 0] + v[-1, 1])) / (8 * cell)
    return n.select("r", "c", F.degrees(F.atan(F.hypot(dx, dy))).alias("slope"), ((F.degrees(F.atan2(dy, -dx)) + 360) % 360).alias("aspect")).where("slope IS NOT NULL")
