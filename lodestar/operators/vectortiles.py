"""Vector tiles: simplification that keeps shared borders, features cut to tiles, and tiles encoded as delta-coded commands with shared dictionaries."""

from __future__ import annotations

import math
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as Y

c = F.col
MARKED = "array<struct<x:double,y:double,fixed:boolean>>"
#: Fixed values of the format: field numbers and kinds, commands, and the version that tiles carry.
POINT, LINE, POLYGON = 1, 2, 3
MOVE, DRAW, CLOSE, VERSION = 1, 2, 7, 2


def marked(layer: DataFrame) -> DataFrame:
    """A layer (id, ring) with the points of each ring marked `fixed` where other than two borders meet: there, however rings run, the same point ends the border that they share."""
    corners = layer.select("id", F.posexplode(F.slice("ring", 1, F.greatest(F.size("ring") - 1, F.lit(0)))).alias("k", "p"), F.size("ring").alias("n"), "ring")
    at = lambda k: F.get("ring", k)
    steps = corners.select(c("p.x").alias("x"), c("p.y").alias("y"), F.explode(F.array(at(F.when(c("k") == 0, c("n") - 2).otherwise(c("k") - 1)), at(c("k") + 1))).alias("q"))
    forks = steps.distinct().groupBy("x", "y").agg((F.count("*") != 2).alias("fixed"))
    back = corners.select("id", "k", c("p.x").alias("x"), c("p.y").alias("y")).join(forks, ["x", "y"])
    return back.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "fixed"))).alias("p")).select("id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["fixed"].alias("fixed"))).alias("points"))


def _simple_ring(points: list[tuple[float, float, bool]], tolerance: float) -> list[tuple[float, float]]:
    """A ring with each border between fixed points simplified in the direction of its lesser end, so that both rings along it keep the same points."""
    xy = [(x, y) for x, y, _ in points]
    stops = [k for k, p in enumerate(points) if p[2]]
    if len(stops) < 2:  # a border of its own: begin at its least point and turn at the farthest from it
        first = stops[0] if stops else min(range(len(xy)), key=xy.__getitem__)
        far = max(range(len(xy)), key=lambda k: (math.dist(xy[k], xy[first]), xy[k]))
        stops = sorted({first, far})
    out: list = []
    for a, b in zip(stops, stops[1:] + [stops[0] + len(xy)]):
        line = [xy[k % len(xy)] for k in range(a, b + 1)]
        turned = line[::-1] < line
        line = Y.far_points(line[::-1] if turned else line, tolerance)
        out += (line[::-1] if turned else line)[:-1]
    return out + out[:1]


def simplify_layer(layer: DataFrame, tolerance: float) -> DataFrame:
    """(id, ring) of a layer of rings that share borders, simplified to `tolerance`: neighbours still share every border. Rings that shrink to less than a triangle go."""
    @F.pandas_udf(Y.RING)
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: [{"x": x, "y": y} for x, y in _simple_ring([(p["x"], p["y"], p["fixed"]) for p in r], tolerance)])

    return marked(layer).select("id", run("points").alias("ring")).where("size(ring) > 3")


def tolerance_at(zoom: int, pixels: float = 1.0) -> float:
    """Degrees of `pixels` screen pixels of 256 a tile: it halves with every level."""
    return 360.0 / (256 << zoom) * pixels


def to_world(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Place in the unit square of all tiles, cut to the latitudes that tiles cover."""
    cut = F.greatest(F.lit(-85.0511287798066), F.least(lat, F.lit(85.0511287798066)))
    return (lon + 180) / 360, (1 - F.asinh(F.tan(F.radians(cut))) / math.pi) / 2


def cut_to_tiles(features: DataFrame, zoom: int, extent: int = 4096, buffer: int = 64) -> DataFrame:
    """Features (id, kind, points in degrees, tags map<string,string>) as (z, x, y, id, kind, cells, tags): the part in each tile and its buffer, in whole cells.

    A point lies in the tiles whose buffered square holds it; lines and rings go to all tiles their box meets, rings are cut to the buffered square, lines
    are left whole. Cells repeat no point; what becomes smaller than its kind needs is left out.
    """
    n = 1 << zoom
    spare = buffer / extent
    tile = lambda v: F.greatest(F.lit(0), F.least(F.floor(v), F.lit(n - 1))).cast("int")
    wx, wy = (lambda p: to_world(p["x"], p["y"])[0] * n), (lambda p: to_world(p["x"], p["y"])[1] * n)
    scaled = features.withColumn("w", F.transform("points", lambda p: F.struct(wx(p).alias("x"), wy(p).alias("y")))).withColumn("b", Y.bbox(c("w")))
    spread = scaled.withColumn("x", F.explode(F.sequence(tile(c("b.minx") - spare), tile(c("b.maxx") + spare)))).withColumn("y", F.explode(F.sequence(tile(c("b.miny") - spare), tile(c("b.maxy") + spare))))
    part = F.when(c("kind") == POLYGON, Y.clip_to_box(c("w"), c("x") - spare, c("y") - spare, c("x") + 1 + spare, c("y") + 1 + spare)).otherwise(c("w"))
    cell = lambda p: F.struct(F.floor((p["x"] - c("x")) * extent).cast("int").alias("x"), F.floor((p["y"] - c("y")) * extent).cast("int").alias("y"))
    cells = F.transform(part, cell)
    fresh = F.filter(F.transform(cells, lambda p, k: F.struct(p["x"].alias("x"), p["y"].alias("y"), ((k == 0) | (p != F.get(cells, k - 1))).alias("new"))), lambda p: p["new"])
    out = spread.select(F.lit(zoom).alias("z"), "x", "y", "id", "kind", "tags", F.transform(fresh, lambda p: F.struct(p["x"], p["y"])).alias("cells"))
    # a ring comes closed, its last point again the first
    return out.where((c("kind") == POINT) | ((c("kind") == LINE) & (F.size("cells") > 1)) | ((c("kind") == POLYGON) & (F.size("cells") > 3)))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, content: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(content)) + content


def _commands(kind: int, cells: list[tuple[int, int]]) -> list[int]:
    out, at = [], (0, 0)
    last = cells[:-1] if kind == POLYGON else cells

    def go(points):
        nonlocal at
        for x, y in points:
            dx, dy = x - at[0], y - at[1]
            out.extend((dx << 1 ^ dx >> 31, dy << 1 ^ dy >> 31))
            at = (x, y)

    first = last if kind == POINT else last[:1]
    out.append(MOVE | len(first) << 3)
    go(first)
    if kind != POINT:
        out.append(DRAW | len(last) - 1 << 3)
        go(last[1:])
    if kind == POLYGON:
        out.append(CLOSE | 1 << 3)
    return out


def _value(v: str | float | int | bool) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(6 << 3) + _varint(v << 1 ^ v >> 63)
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, v.encode())


def encode_layer(name: str, features: list[dict], extent: int = 4096) -> bytes:
    """One layer as bytes, of features {id, kind, cells, tags}; equal keys and values are written once."""
    keys: dict = {}
    values: dict = {}
    body = bytearray()
    for f in features:
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v), v), len(values))) for k, v in f["tags"])
        numbers = b"".join(map(_varint, _commands(f["kind"], f["cells"])))
        body += _field(2, _varint(1 << 3) + _varint(f["id"]) + _field(2, tags) + _varint(3 << 3) + _varint(f["kind"]) + _field(4, numbers))
    head = _varint(15 << 3) + _varint(VERSION) + _field(1, name.encode())
    tables = b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values)
    return _field(3, head + bytes(body) + tables + _varint(5 << 3) + _varint(extent))


def _fields(data: bytes):
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 == 1:
            yield tag >> 3, struct.unpack("<d", data[at : at + 8])[0]
            at += 8
        else:
            yield tag >> 3, varint()


def _numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(n)
            n = shift = 0
    return out


def decode_layer(tile: bytes) -> list[dict]:
    """The features {layer, id, kind, cells, tags} of a tile, in their order."""
    out = []
    for _, layer in _fields(tile):
        parts = list(_fields(layer))
        name = next(v for k, v in parts if k == 1).decode()
        keys = [v.decode() for k, v in parts if k == 3]
        values = []
        for k, v in parts:
            if k == 4:
                kind, raw = next(iter(_fields(v)))
                values.append(raw.decode() if kind == 1 else raw >> 1 ^ -(raw & 1) if kind == 6 else bool(raw) if kind == 7 else raw)
        for k, v in parts:
            if k != 2:
                continue
            f = dict(_fields(v))
            tags, numbers = _numbers(f.get(2, b"")), _numbers(f[4])
            cells, x, y, at = [], 0, 0, 0
            while at < len(numbers):
                command, count = numbers[at] & 7, numbers[at] >> 3
                at += 1
                if command == CLOSE:
                    cells.append(cells[0])
                    continue
                for _ in range(count):
                    dx, dy = (n >> 1 ^ -(n & 1) for n in numbers[at : at + 2])
                    x, y, at = x + dx, y + dy, at + 2
                    cells.append((x, y))
            out.append({"layer": name, "id": f[1], "kind": f[3], "cells": cells, "tags": [(keys[a], values[b]) for a, b in zip(tags[::2], tags[1::2])]})
    return out


def encode_tiles(cut: DataFrame, name: str, most_points: int = 50_000, extent: int = 4096) -> DataFrame:
    """(z, x, y, part, tile): features of `cut_to_tiles` as encoded tiles. A tile of more than about `most_points` points is dealt into parts by hashed ids, each a tile of its own that is drawn over the others, so that no task holds a dense tile whole."""
    weight = cut.groupBy("z", "x", "y").agg(F.sum(F.size("cells")).alias("w")).select("z", "x", "y", F.ceil(c("w") / most_points).cast("int").alias("parts"))
    dealt = cut.join(weight, ["z", "x", "y"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = sorted(rows.select(["id", "kind", "cells", "tags"]).to_pylist(), key=lambda r: (r["id"], len(r["cells"])))
        features = [{"id": r["id"], "kind": r["kind"], "cells": [(p["x"], p["y"]) for p in r["cells"]], "tags": sorted(r["tags"] or [])} for r in found]
        z, x, y, part = (k.as_py() for k in key)
        return pa.Table.from_pydict({"z": pa.array([z], pa.int32()), "x": pa.array([x], pa.int32()), "y": pa.array([y], pa.int32()), "part": pa.array([part], pa.int32()), "tile": pa.array([encode_layer(name, features, extent)], pa.binary())})

    return dealt.groupBy("z", "x", "y", "part").applyInArrow(run, "z int, x int, y int, part int, tile binary")


DECODED = "z int, x int, y int, part int, layer string, id long, kind int, cells array<struct<x:int,y:int>>, tags map<string,string>"


def decode_tiles(tiles: DataFrame) -> DataFrame:
    """The features of encoded tiles: z, x, y, part, layer, id, kind, cells, tags as text."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = [{k: r[k] for k in ("z", "x", "y", "part")} | {"layer": f["layer"], "id": f["id"], "kind": f["kind"], "cells": [{"x": a, "y": b} for a, b in f["cells"]], "tags": [(k, str(v)) for k, v in f["tags"]]} for f in decode_layer(r["tile"])]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    cell = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
    schema = pa.schema([*[(k, pa.int32()) for k in ("z", "x", "y", "part")], ("layer", pa.string()), ("id", pa.int64()), ("kind", pa.int32()), ("cells", cell), ("tags", pa.map_(pa.string(), pa.string()))])
    return tiles.select("z", "x", "y", "part", "tile").mapInArrow(run, DECODED)


def write_tiles(tiles: DataFrame, path: str, mode: str = "error") -> None:
    """Tiles as a table by zoom level, with the path z/x/y each belongs to."""
    tiles.withColumn("path", F.concat_ws("/", "z", "x", F.concat("y", F.lit(".mvt")))).write.mode(mode).partitionBy("z").parquet(path)
