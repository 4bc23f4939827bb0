import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry as Y
from lodestar.operators import stateful as T
from lodestar.operators import vectortiles as V
from lodestar.sources import files as S
from lodestar.sources import paged


class Service(BaseHTTPRequestHandler):
    """Items 0..n-1 in the way each kind of service gives them; some requests fail first, and a token is asked for."""

    n, failed, asked = 57, set(), []

    def do_GET(self):
        ask = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        kind = urlparse(self.path).path.strip("/")
        Service.asked.append((kind, ask))
        if self.headers.get("Authorization") != "Bearer secret":
            return self.send_error(403)
        size = int(ask.get("per_page") or ask.get("count") or ask.get("limit") or ask.get("resultRecordCount"))
        start = (int(ask["page"]) - 1) * size if "page" in ask else int(ask.get("startIndex") or ask.get("offset") or ask.get("resultOffset"))
        if start // size % 2 and (kind, start) not in Service.failed:
            Service.failed.add((kind, start))
            return self.send_error(503)
        items = [{"id": k, "v": k * k} for k in range(start, min(start + size, Service.n))]
        body = {"rest": {"items": items}, "wfs": {"features": items, "numberMatched": Service.n}, "features": {"features": items, "numberMatched": Service.n}, "arcgis": {"features": items, "count": Service.n}, "list": items}[kind]
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize("kind", sorted(paged.KINDS))
def test_paged_services(spark, service, kind):
    paged.register(spark)
    df = spark.read.format("paged").options(url=f"{service}/{kind}", kind=kind, size=10, token="secret", wait="0.01", pagesPerPartition=2).load()
    rows = df.collect()
    assert sorted(int(r.id) for r in rows) == list(range(57)) and all(json.loads(r.body)["v"] == int(r.id) ** 2 for r in rows)
    assert df.rdd.getNumPartitions() == (1 if kind == "rest" else 3)
    if kind == "wfs":
        with pytest.raises(Exception, match="403"):
            spark.read.format("paged").options(url=f"{service}/wfs", kind="wfs", size=10, token="wrong").load().collect()
        with pytest.raises(Exception, match="kind is one of"):
            spark.read.format("paged").options(url=service, kind="other").load().collect()


def test_paged_stream_goes_on_where_it_stopped(spark, service, tmp_path):
    paged.register(spark)
    opts = dict(url=f"{service}/features", kind="features", size=10, token="secret", wait="0.01", pagesPerBatch=3)

    def run():
        q = spark.readStream.format("paged").options(**opts).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
        return sorted(int(r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(50))  # the last page still grows
    Service.n = 75
    assert run() == list(range(70))
    Service.n = 57


def test_kml_with_data_and_archives(spark, tmp_path):
    import zipfile

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [("a", "x < y & z", [(1.5, 2.5)], {"k": "v", "n": "1"}), ("b", None, [(0.0, 0.0), (1.0, 1.0)], None), ("c", "", ring, {"k": "ü"})]
    df = spark.createDataFrame(rows, f"name string, description string, points {Y.RING}, data map<string,string>")
    S.write_kml(df.coalesce(1), f"{tmp_path}/kml")
    same = lambda got: {(r.name, tuple(map(tuple, r.points)), tuple(sorted((r.data or {}).items()))) for r in got.collect()}
    want = {(n, tuple(p), tuple(sorted((m or {}).items()))) for n, _, p, m in rows}
    assert same(S.read_kml(spark, f"{tmp_path}/kml")) == want
    text = next(tmp_path.glob("kml/part-*")).read_text()
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("doc.kml", text)
        z.writestr("files/note.txt", "<Placemark>no</Placemark>")
    assert same(S.read_kmz(spark, f"{tmp_path}/a.kmz")) == want


def test_reports_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([("a <b>", 1, 2.5), ("c", None, None)], "name string, n int, x double")
    S.write_report(df, f"{tmp_path}/r", "excel")
    assert '"Number"' in next(tmp_path.glob("r/part-*")).read_text()
    assert [tuple(r) for r in S.read_report(spark, f"{tmp_path}/r", df.columns).collect()] == [("a <b>", "1", "2.5"), ("c", None, None)]
    with pytest.raises(ValueError):
        S.write_report(df, f"{tmp_path}/s", "word")
    seen, stats = S.flow_statistics(df, "flow", F.col("n").isNotNull())
    seen.collect()
    assert stats.get == {"records": 2, "bytes": sum(len(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()), "good": 1}


def test_folds_with_late_rows_and_a_restart(spark, tmp_path):
    import random

    from lodestar.queries.stateful import rocks

    rnd = random.Random(3)
    rows = [(k, rnd.randrange(4), 60 * k + rnd.randrange(-300, 300), rnd.uniform(0, 9)) for k in range(400)]
    at = lambda t: f"2024-03-01 {12 + (t + 3600) // 3600:02d}:{(t + 3600) // 60 % 60:02d}:{(t + 3600) % 60:02d}"
    batches = [rows[:150], rows[150:300], rows[300:] + [(9999, 9, 10 * 3600, 0.0)]]
    schema = "id long, key long, ts timestamp, value double"
    step, start, state = T.token_step(3.0, 1 / 150), (3.0,), f"{tmp_path}/state"
    for n, batch in enumerate(batches):  # the query is started anew for each
        spark.createDataFrame([(i, k, at(t), v) for i, k, t, v in batch], "id long, key long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        with rocks(spark):
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            q = T.fold_stream(stream, "key", "ts", "id", "value", "30 minutes", start, step).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination()
    want = {}
    for k in range(4):
        numbers, last = start, None
        for i, _, t, v in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            numbers, want[i] = step(numbers, 0 if last is None else (t - last) * 10**6, v)
            last = t
    got = {r.id: r.result for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and 0 < sum(got.values()) < 400


def test_tiles_give_their_features_back():
    features = [
        {"id": 7, "kind": V.POINT, "cells": [(5, -3)], "tags": [("a", "x"), ("n", -12), ("f", 2.5), ("b", True)]},
        {"id": 300, "kind": V.LINE, "cells": [(0, 0), (4096, 17), (-64, 4160)], "tags": [("a", "x"), ("a2", "")]},
        {"id": 2**40, "kind": V.POLYGON, "cells": [(1, 1), (9, 1), (9, 9), (1, 1)], "tags": []},
    ]
    data = V.encode_layer("roads ü", features)
    assert V.decode_layer(data) == [{"layer": "roads ü"} | f for f in features]
    assert data.count(b"\n\x01x") == 1 and V.decode_layer(V.encode_layer("none", [])) == []
    # the example of the format: a point at (25, 17), and a ring (3,6) (8,12) (20,34)
    assert V._commands(V.POINT, [(25, 17)]) == [9, 50, 34] and V._commands(V.POLYGON, [(3, 6), (8, 12), (20, 34), (3, 6)]) == [9, 6, 12, 18, 10, 12, 24, 44, 15]


def test_simplified_neighbours_share_their_border(spark):
    import math

    wave = [(math.sin(k / 7), k / 10) for k in range(101)]
    left = [(-5.0, 0.0), *wave, (-5.0, 10.0), (-5.0, 0.0)]
    right = [(5.0, 0.0), (5.0, 10.0), *wave[::-1], (5.0, 0.0)]
    island = [(20 + math.cos(k / 20 * math.pi), math.sin(k / 20 * math.pi)) for k in range(40)]
    around = [(20 + 3 * math.cos(-k / 20 * math.pi), 3 * math.sin(-k / 20 * math.pi)) for k in range(40)]
    rings = [(1, left), (2, right), (3, island + island[:1]), (4, island[7:] + island[:8]), (5, around + around[:1])]
    got = {r.id: [tuple(p) for p in r.ring] for r in V.simplify_layer(spark.createDataFrame(rings, f"id long, ring {Y.RING}"), 0.1).collect()}
    edges = lambda ring: {frozenset(e) for e in zip(ring, ring[1:])}
    assert all(len(got[k]) < len(r) / 2 for k, r in rings) and got[1][0] == got[1][-1]
    inner = lambda ring: {e for e in edges(ring) if all(abs(x) <= 1 for x, _ in e)}
    assert inner(got[1]) == inner(got[2]) and len(inner(got[1])) > 5
    assert edges(got[3]) == edges(got[4]) and (V.tolerance_at(3), V.tolerance_at(4)) == (360 / 2048, 360 / 4096)


def test_dense_tiles_come_in_parts_and_polygons_are_cut(spark):
    rows = [(k, V.POINT, [(10.0 + k / 1e4, 10.0)], {"k": str(k)}) for k in range(200)] + [(1000, V.POLYGON, [(-40.0, -40.0), (40.0, -40.0), (40.0, 40.0), (-40.0, 40.0), (-40.0, -40.0)], None)]
    df = spark.createDataFrame(rows, f"id long, kind int, points {Y.RING}, tags map<string,string>")
    tiles = V.encode_tiles(V.cut_to_tiles(df, 3), "l", most_points=50)
    got = V.decode_tiles(tiles).collect()
    assert sorted(r.id for r in got if r.kind == V.POINT) == list(range(200)) and max(r["count"] for r in tiles.groupBy("x", "y").count().collect()) >= 4
    parts = [r for r in got if r.id == 1000]
    assert {(r.x, r.y) for r in parts} == {(x, y) for x in (3, 4) for y in (3, 4)} and all(-65 <= p.x <= 4160 for r in parts for p in r.cells)
    assert all(r.cells[0] == r.cells[-1] for r in parts)
