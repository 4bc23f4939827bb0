"""Registered queries: vector tiles (families A and J)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoint import checkpoint_dir
from ..fixtures import load
from ..functions import geometry as Y
from ..operators import vectortiles as V
from ..registry import query

c = F.col
Z = 4
WX, WY = f"((lon+180)/360*{1 << Z})", f"((1-asinh(tan(radians(lat)))/pi())/2*{1 << Z})"


def points(s, d):
    p = load(s, d, "fx_points")
    return p.select("id", F.lit(V.POINT).alias("kind"), F.array(Y.point(c("lon"), c("lat"))).alias("points"), F.create_map(F.lit("grp"), c("grp").cast("string"), F.lit("side"), F.when(c("lon") < 0, "west").otherwise("east")).alias("tags"))


@query("j12_encode_points", f"""SELECT {Z} AS z, x::INT AS x, y::INT AS y, id, floor(({WX}-x)*4096)::INT AS px, floor(({WY}-y)*4096)::INT AS py, grp::VARCHAR AS grp, CASE WHEN lon < 0 THEN 'west' ELSE 'east' END AS side
  FROM fx_points, range({1 << Z}) a(x), range({1 << Z}) b(y) WHERE {WX} >= x-1/64.0 AND {WX} < x+1+1/64.0 AND {WY} >= y-1/64.0 AND {WY} < y+1+1/64.0""")
def j12(s, d):
    """Points encoded as tiles and decoded again; dense tiles come in parts."""
    tiles = V.encode_tiles(V.cut_to_tiles(points(s, d), Z), "points", most_points=20)
    got = V.decode_tiles(tiles)
    return got.select("z", "x", "y", "id", F.get("cells", F.lit(0))["x"].alias("px"), F.get("cells", F.lit(0))["y"].alias("py"), c("tags")["grp"].alias("grp"), c("tags")["side"].alias("side"))


@query("j12_part_sizes", f"""SELECT x::INT AS x, y::INT AS y, count(*) AS n FROM fx_points, range({1 << Z}) a(x), range({1 << Z}) b(y) WHERE {WX} >= x-1/64.0 AND {WX} < x+1+1/64.0 AND {WY} >= y-1/64.0 AND {WY} < y+1+1/64.0 GROUP BY 1, 2""")
def j12_parts(s, d):
    """Features by tile over all its parts."""
    count = F.udf(lambda t: len(V.decode_layer(bytes(t))), "int")
    tiles = V.encode_tiles(V.cut_to_tiles(points(s, d), Z), "points", most_points=20)
    return tiles.groupBy("x", "y").agg(F.sum(count("tile")).alias("n"))


def lots(s, d, every=0.25):
    """Rings of lots with points along their sides."""
    return load(s, d, "fx_lots").select("id", Y.densify(Y.box_ring(c("minx"), c("miny"), c("maxx"), c("maxy")), F.lit(every)).alias("ring"))


@query("j9_simplify_layer", "SELECT id, (maxx-minx)*(maxy-miny) AS area, minx, maxy FROM fx_lots")
def j9(s, d):
    """Points on straight sides go; areas and corners stay."""
    r = V.simplify_layer(lots(s, d), V.tolerance_at(12))
    box = Y.bbox(c("ring"))
    return r.select("id", F.round(F.abs(Y.area(c("ring"))), 6).alias("area"), box["minx"].alias("minx"), box["maxy"].alias("maxy"))


@query("a11_tile_sink", "SELECT z::INT AS z, id, true AS whole FROM fx_lots, (VALUES (1), (3)) t(z) WHERE minx-180 < 175")
def a11(s, d):
    """Lots, simplified for two zoom levels, as tiles in a table by level, read again and decoded."""
    at = f"{checkpoint_dir(s)}/tiles-{uuid.uuid4().hex}"
    shift = F.transform("ring", lambda p: Y.point(p["x"] - 180, p["y"] - 70))
    base = load(s, d, "fx_lots").where("minx - 180 < 175").select("id", F.concat(F.lit("lot "), "id").alias("name"))
    for zoom in (1, 3):
        rings = V.simplify_layer(lots(s, d, 1.0), V.tolerance_at(zoom, 0.01)).withColumn("points", shift).join(base, "id")
        features = rings.select("id", F.lit(V.POLYGON).alias("kind"), "points", F.create_map(F.lit("name"), "name").alias("tags"))
        V.write_tiles(V.encode_tiles(V.cut_to_tiles(features, zoom), "lots", most_points=500), at, "append")
    got = V.decode_tiles(s.read.parquet(at).withColumn("z", c("z").cast("int")))
    return got.groupBy("z", "id").agg(F.bool_and((F.size("cells") > 3) & (c("tags")["name"] == F.concat(F.lit("lot "), "id"))).alias("whole"))
