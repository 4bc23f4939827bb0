import datetime
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as Y
from lodestar.operators import pipelines as P
from lodestar.sources import files as S


def test_csv_points_and_wkt(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id;lon;lat\n1;10.5;20\n2;x;3\n")
    got = {r.id: r.point and tuple(r.point) for r in S.read_csv_points(spark, str(tmp_path / "p.csv"), "lon", "lat", ";").collect()}
    assert got == {"1": (10.5, 20.0), "2": None}
    rings = spark.createDataFrame([(7, [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0)])], f"id int, ring {Y.RING}")
    S.write_csv_wkt(rings, str(tmp_path / "w"), "ring")
    back = S.read_csv_wkt(spark, str(tmp_path / "w")).select("id", Y.area(F.col("ring")).alias("a")).first()
    assert (back.id, back.a) == ("7", 3.0)


def test_geojson(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "a", "properties": {"n": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}}, {"type": "Feature", "id": "b", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "x.geojson").write_text(json.dumps(f))
    rows = {r.id: r for r in S.read_geojson(spark, str(tmp_path / "x.geojson")).collect()}
    assert rows["a"].properties == {"n": "1"} and rows["b"].kind == "Point" and json.loads(rows["b"].geometry)["coordinates"] == [1, 2]
    area = S.read_geojson(spark, str(tmp_path / "x.geojson")).where("kind = 'Polygon'").select(Y.area(Y.from_geojson(F.col("geometry"))).alias("a")).first().a
    assert area == 8.0
    rings = spark.createDataFrame([(7, [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0)])], f"id int, ring {Y.RING}")
    S.write_geojson_lines(rings, str(tmp_path / "out"), "ring", compression="gzip")
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert line["properties"] == {"id": 7} and line["geometry"]["coordinates"][0][1] == [2.0, 0.0]


def test_kml_arrow_and_detection(spark, tmp_path):
    (tmp_path / "k.kml").write_text('<?xml version="1.0"?><kml><Document><Placemark><name>A</name><description>d</description><Point><coordinates>1.5,2.5,0</coordinates></Point></Placemark><Placemark><name>B</name><LineString><coordinates>0,0 3,4</coordinates></LineString></Placemark></Document></kml>')
    got = {r.name: r for r in S.read_kml(spark, str(tmp_path / "k.kml")).collect()}
    assert tuple(got["A"].points[0]) == (1.5, 2.5) and [tuple(p) for p in got["B"].points] == [(0.0, 0.0), (3.0, 4.0)]
    table = pa.table({"k": pa.array([1, 2, 3], pa.int64()), "v": ["a", None, "c"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as out, pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    assert sorted(map(tuple, S.read_arrow(spark, str(tmp_path / "t.arrow"), "k long, v string").collect())) == [(1, "a"), (2, None), (3, "c")]
    with zipfile.ZipFile(tmp_path / "z.kmz", "w") as z:
        z.writestr("doc.kml", "x")
    (tmp_path / "odd.bin").write_bytes(b"??")
    kinds = {r.path.rsplit("/", 1)[1]: r.format for r in S.detect_formats(spark, str(tmp_path)).collect()}
    assert kinds == {"k.kml": "kml", "t.arrow": "arrow", "z.kmz": "kmz", "odd.bin": "unknown"}


def test_write_modes(spark, tmp_path):
    df, at = spark.range(5), str(tmp_path / "t")
    S.write_table(df, at)
    with pytest.raises(Exception):
        S.write_table(df, at)
    S.write_table(df, at, mode="CreateIfNotExists")
    S.write_table(df, at, mode="Append", compression="gzip")
    assert spark.read.parquet(at).count() == 10
    S.write_table(df, at, mode="Overwrite", compression="zstd")
    assert spark.read.parquet(at).count() == 5


def test_declared_pipelines(spark):
    spec = {"source": "x", "steps": [{"kind": "filter", "where": {"field": "id", "op": "gt", "value": 2}}, {"kind": "nope"}]}
    assert P.validate(spec) == ["step 1: unknown kind nope"] and P.validate({}) == ["no source"]
    with pytest.raises(ValueError):
        P.run_steps(spark.range(5), spec)
    out, seen = P.run_steps(spark.range(10), {"source": "x", "steps": [{"kind": "filter", "where": {"field": "id", "op": "gt", "value": 2}}, {"kind": "map", "columns": {"b": "id % 2"}}, {"kind": "group", "by": ["b"], "metrics": [("n", "count", "*")]}]}, observe=True)
    assert sorted(map(tuple, out.collect())) == [(0, 3), (1, 4)] and [o.get["rows"] for o in seen] == [7, 7, 2]


def write_day(spark, where, name, rows):
    times = [(datetime.datetime(2024, 1, d, h), k) for d, h, k in rows]
    spark.createDataFrame(times, "ts timestamp, k string").coalesce(1).write.mode("append").parquet(f"{where}/{name}")


def test_late_rows_are_dropped_and_streams_go_on_where_they_stopped(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    counts = lambda: P.late_tolerant_counts(spark.readStream.schema("ts timestamp, k string").option("recursiveFileLookup", "true").parquet(src), "ts", "1 day", "1 day", "k")
    write_day(spark, src, "a", [(1, 5, "x"), (1, 9, "x"), (2, 1, "x"), (4, 0, "x")])
    P.run_once(counts(), out, state)
    first = {(r.start.day, r.n) for r in spark.read.parquet(out).collect()}
    assert first == {(1, 2), (2, 1)}
    write_day(spark, src, "b", [(1, 7, "x"), (4, 3, "x"), (7, 0, "x")])  # the first is too late
    P.run_once(counts(), out, state)
    assert {(r.start.day, r.n) for r in spark.read.parquet(out).collect()} == {(1, 2), (2, 1), (4, 2)}


def test_keys_are_seen_once_in_a_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    once = lambda: P.once_per_key(spark.readStream.schema("ts timestamp, k string").option("recursiveFileLookup", "true").parquet(src), "ts", ["k"], "10 days")
    write_day(spark, src, "a", [(1, 5, "x"), (1, 9, "x"), (2, 1, "y")])
    P.run_once(once(), out, state)
    write_day(spark, src, "b", [(3, 7, "x"), (3, 3, "z")])
    P.run_once(once(), out, state)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["x", "y", "z"]


def test_merging_a_batch_twice_changes_nothing(spark, tmp_path):
    put = P.merge_into(str(tmp_path / "t"), "k", "seq")
    one, two = (spark.createDataFrame(r, "k string, seq int, v int") for r in ([("a", 1, 10), ("b", 1, 20)], [("a", 3, 30), ("a", 2, 25)]))
    put(one, 0)
    put(two, 1)
    put(two, 1)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t/v=1").collect())) == [("a", 3, 30), ("b", 1, 20)]
