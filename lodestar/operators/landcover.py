"""Unsupervised classes of pixels by splitting and merging clusters, and a minimum mapping unit by contraction of the region graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import written
from .graph import components

c = F.col


def _nearest(bands: list[str], centres: list[tuple[float, ...]]) -> Column:
    """Number of the nearest centre, ties to the first."""
    each = [F.struct(sum((F.pow(c(b) - v, F.lit(2)) for b, v in zip(bands, m)), F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, m in enumerate(centres)]
    return F.array_min(F.array(*each))["k"]


def isodata(pixels: DataFrame, bands: list[str], start: list[tuple[float, ...]], rounds: int = 20, least: int = 10, spread: float = 0.15, near: float = 0.1, most: int = 16) -> list[tuple[float, ...]]:
    """Centres of clusters that adjust their number.

    Each round assigns every pixel and takes counts, means and deviations per cluster in one aggregation. Then clusters of fewer than `least` pixels go; on
    odd rounds a cluster whose widest band deviates by more than `spread` is split along it by one deviation either way, if it
    has twice `least` pixels and `most` is not reached; on even rounds pairs of centres nearer than `near` merge, nearest first, each cluster
    once, weighted by counts. Ends when a pair of rounds moves no centre by more than 1e-9. Pixels with a null band take no part. The driver holds centres alone.
    """
    known = pixels.where(" AND ".join(f"{b} IS NOT NULL" for b in bands))
    centres, quiet = list(start), 0
    for turn in range(rounds):
        stats = known.withColumn("k", _nearest(bands, centres)).groupBy("k").agg(F.count("*").alias("n"), *[F.avg(b).alias(f"m{i}") for i, b in enumerate(bands)], *[F.stddev_pop(b).alias(f"s{i}") for i, b in enumerate(bands)]).orderBy("k").collect()
        if not stats:
            return centres
        kept = [r for r in stats if r["n"] >= least] or [max(stats, key=lambda r: r["n"])]
        groups = [(r["n"], tuple(r[f"m{i}"] for i in range(len(bands))), tuple(r[f"s{i}"] for i in range(len(bands)))) for r in kept]
        new = [m for _, m, _ in groups]
        if turn % 2 and turn < rounds - 1:  # the last round splits nothing
            new = []
            room = most - len(groups)
            for n, m, s in groups:
                i = max(range(len(bands)), key=lambda k: s[k])
                if s[i] > spread and n >= 2 * least and room > 0:
                    room -= 1
                    new += [tuple(v + way * s[i] * (k == i) for k, v in enumerate(m)) for way in (-1, 1)]
                else:
                    new.append(m)
        else:
            pairs = sorted((math.dist(a[1], b[1]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups[x + 1 :], x + 1))
            used: set[int] = set()
            merged = []
            for d, x, y in pairs:
                if d < near and not {x, y} & used:
                    used |= {x, y}
                    n, m = groups[x][0] + groups[y][0], zip(groups[x][1], groups[y][1])
                    merged.append(tuple((groups[x][0] * a + groups[y][0] * b) / n for a, b in m))
            new = [g[1] for k, g in enumerate(groups) if k not in used] + merged
        quiet = quiet + 1 if len(new) == len(centres) and all(math.dist(a, b) <= 1e-9 for a, b in zip(new, centres)) else 0
        centres = new
        if quiet == 2:
            break
    return centres


def classified(pixels: DataFrame, bands: list[str], centres: list[tuple[float, ...]]) -> DataFrame:
    """`pixels` with `class`, the number of the nearest centre; null where a band is null."""
    return pixels.withColumn("class", F.when(sum((c(b).isNull().cast("int") for b in bands), F.lit(0)) == 0, _nearest(bands, centres)))


def region_ids(cells: DataFrame) -> DataFrame:
    """Cells (r, c, class) with `region`, the least cell number of all that touch by a side with one class; a cell's number is r * 2**20 + c."""
    keyed = cells.withColumn("node", c("r") * (1 << 20) + c("c"))
    there = keyed.select(c("r").alias("r2"), c("c").alias("c2"), c("class").alias("class2"), c("node").alias("dst"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")), F.struct(F.lit(0).alias("i"), F.lit(1).alias("j"))))
    sides = keyed.withColumn("s", step).withColumn("r2", c("r") + c("s.i")).withColumn("c2", c("c") + c("s.j")).join(there, ["r2", "c2"]).where(c("class") == c("class2")).select(c("node").alias("src"), "dst")
    named = components(sides, keyed.select("node"))
    return keyed.join(named, "node").select("r", "c", "class", c("component").alias("region"))


def sieve(cells: DataFrame, unit: int, rounds: int = 200) -> DataFrame:
    """(r, c, class) of cells (r, c, class) where no region has fewer than `unit` cells, unless it has no neighbour.

    Regions are contracted to a graph with sizes and lengths of shared borders; cells take no part in the rounds. In each round every region under the
    unit that is less, by (size, id), than all its neighbours under the unit joins the neighbour it shares the longest border with (ties:
    the least id) and takes its class; regions of one class that come to touch are one. Regions that move in one round do not touch each other.
    """
    marked = written(region_ids(cells))
    there = marked.select(c("r").alias("r2"), c("c").alias("c2"), c("region").alias("b"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = marked.select("r", "c", c("region").alias("a")).withColumn("s", step).withColumn("r2", c("r") + c("s.i")).withColumn("c2", c("c") + c("s.j")).join(there, ["r2", "c2"])
    border = written(near.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w")))
    nodes = written(marked.groupBy("region").agg(F.count("*").alias("size"), F.first("class").alias("class")))
    names = written(nodes.select(c("region").alias("old"), "region"))
    for _ in range(rounds):
        small = nodes.where(c("size") < unit)
        rank = lambda p: small.select(c("region").alias(p), F.struct("size", c("region").alias("id")).alias(f"rank_{p}"))
        # the least small neighbour of each small region
        beside = border.join(rank("a"), "a").join(rank("b"), "b", "left").groupBy("a").agg(F.first("rank_a").alias("mine"), F.min("rank_b").alias("other"), F.max(F.struct("w", (-c("b")).alias("id"))).alias("best"))
        moves = written(beside.where(c("other").isNull() | (c("mine") < c("other"))).select(c("a").alias("region"), (-c("best.id")).alias("to")))
        if moves.isEmpty():
            back = marked.select("r", "c", c("region").alias("old")).join(names, "old").join(nodes.select("region", "class"), "region")
            return back.select("r", "c", "class")
        # a region that moves has no neighbour that moves, so one step names all
        classes = nodes.join(moves, "region", "left").select("region", F.coalesce("to", "region").alias("to"), "size", "class")
        classes = written(classes)
        whole = written(classes.groupBy(c("to").alias("region")).agg(F.sum("size").alias("size"), F.max(F.when(c("region") == c("to"), c("class"))).alias("class")))
        to = lambda p: classes.select(c("region").alias(p), c("to").alias(f"to_{p}"))
        joined = written(border.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b").groupBy(c("to_a").alias("a"), c("to_b").alias("b")).agg(F.sum("w").alias("w")))
        # neighbours of one class, where a region between them went, become one
        kind = lambda p: whole.select(c("region").alias(p), c("class").alias(f"class_{p}"))
        same = joined.join(kind("a"), "a").join(kind("b"), "b").where("class_a = class_b AND a < b").select(c("a").alias("src"), c("b").alias("dst"))
        same = written(same)
        every = whole.select(c("region").alias("node"))
        group = written(every.withColumn("component", c("node")) if same.isEmpty() else components(same, every))
        into = lambda p: group.select(c("node").alias(p), c("component").alias(f"in_{p}"))
        nodes = written(whole.join(into("region"), "region").groupBy(c("in_region").alias("region")).agg(F.sum("size").alias("size"), F.first("class").alias("class")))
        border = written(joined.join(into("a"), "a").join(into("b"), "b").where("in_a <> in_b").groupBy(c("in_a").alias("a"), c("in_b").alias("b")).agg(F.sum("w").alias("w")))
        names = written(names.join(moves, "region", "left").select("old", F.coalesce("to", "region").alias("region")).join(into("region"), "region").select("old", c("in_region").alias("region")))
    raise RuntimeError(f"regions were still too small after {rounds} rounds")
