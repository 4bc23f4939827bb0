"""Registered queries: machine-learning features and evaluation, text search, page audits (families G, K and Q)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..operators.search import bm25, positions
from ..registry import query

r6 = lambda c: F.round(c, 6)
TERMS = "SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents"


@query("g1_calendar", "SELECT event_id, year(ts) AS y, month(ts) AS m, dayofmonth(ts) AS d, hour(ts) AS h, dayofweek(ts)+1 AS wd, quarter(ts) AS q, round(sin(2*pi()*hour(ts)/24), 6) AS hs FROM events")
def g1(s, d):
    return load(s, d, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"), F.dayofweek("ts").alias("wd"), F.quarter("ts").alias("q"), r6(F.sin(2 * math.pi * F.hour("ts") / 24)).alias("hs"))


@query("g3_rolling", "SELECT event_id, round(avg(value) OVER w, 6) AS mean5, max(value) OVER w AS max5 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def g3(s, d):
    w = Window.partitionBy("event_type").orderBy("ts").rowsBetween(-4, 0)
    return load(s, d, "events").select("event_id", r6(F.avg("value").over(w)).alias("mean5"), F.max("value").over(w).alias("max5"))


@query("g5_scalers", "SELECT p_partkey, round((p_retailprice-m)/sd, 6) AS z, round((p_retailprice-lo)/(hi-lo), 6) AS unit FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def g5(s, d):
    p = load(s, d, "part")
    m, sd, lo, hi = p.agg(F.avg("p_retailprice"), F.stddev_pop("p_retailprice"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    x = F.col("p_retailprice")
    return p.select("p_partkey", r6((x - m) / sd).alias("z"), r6((x - lo) / (hi - lo)).alias("unit"))


@query("g6_encodings", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment)-1)::BIGINT AS label, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS target FROM customer")
def g6(s, d):
    c = load(s, d, "customer")
    code = c.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("target")).withColumn("label", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("long"))
    return c.join(code, "c_mktsegment").select("c_custkey", "label", "target")


@query("g18_anomaly", "SELECT event_id, abs(value-m)/sd > 1.645 AS odd FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)")
def g18(s, d):
    e = load(s, d, "events")
    m, sd = e.agg(F.avg("value"), F.stddev_pop("value")).first()
    return e.select("event_id", (F.abs(F.col("value") - m) / sd > 1.645).alias("odd"))


@query("g23_confusion", "SELECT y_true, y_pred, count(*) AS n FROM fx_predictions GROUP BY 1, 2")
def g23(s, d):
    return load(s, d, "fx_predictions").groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


@query("g24_precision_recall", "SELECT round(avg((y_true=y_pred)::INT), 6) AS accuracy, round(sum((y_true=1 AND y_pred=1)::INT)/sum(y_pred), 6) AS precision, round(sum((y_true=1 AND y_pred=1)::INT)/sum(y_true), 6) AS recall FROM fx_predictions")
def g24(s, d):
    tp = F.sum(((F.col("y_true") == 1) & (F.col("y_pred") == 1)).cast("int"))
    return load(s, d, "fx_predictions").agg(r6(F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))).alias("accuracy"), r6(tp / F.sum("y_pred")).alias("precision"), r6(tp / F.sum("y_true")).alias("recall"))


@query("g30_drift_psi", "SELECT round(sum((a-b)*ln(a/b)), 6) AS psi FROM (SELECT bin, (sum((k%2=0)::INT)+0.5)/(max(na)+5) AS a, (sum((k%2=1)::INT)+0.5)/(max(nb)+5) AS b FROM (SELECT event_id AS k, least(floor(value/10), 9) AS bin FROM events), (SELECT sum((event_id%2=0)::INT) AS na, sum((event_id%2=1)::INT) AS nb FROM events) GROUP BY 1)")
def g30(s, d):
    e = load(s, d, "events").select((F.col("event_id") % 2).alias("side"), F.least(F.floor(F.col("value") / 10), F.lit(9)).alias("bin"))
    na, nb = e.agg(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).first()
    g = e.groupBy("bin").agg(((F.count_if(F.col("side") == 0) + 0.5) / (na + 5)).alias("a"), ((F.count_if(F.col("side") == 1) + 0.5) / (nb + 5)).alias("b"))
    return g.agg(r6(F.sum((F.col("a") - F.col("b")) * F.log(F.col("a") / F.col("b")))).alias("psi"))


@query("k1_analyze", f"SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_distinct FROM ({TERMS}) GROUP BY 1")
def k1(s, d):
    return terms(s, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_distinct"))


def terms(s, d):
    return load(s, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")


@query("k4_postings", f"SELECT term, doc_id, count(*) AS tf FROM ({TERMS}) GROUP BY 1, 2")
def k4(s, d):
    return terms(s, d).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


@query("k4_index", f"""WITH t AS (SELECT doc_id, unnest(terms) AS term, unnest(range(len(terms))) AS place, len(terms) AS dl FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS terms FROM documents))
  SELECT term, doc_id, count(*) AS tf, list(place ORDER BY place) AS positions, max(dl)::BIGINT AS dl FROM t GROUP BY 1, 2""")
def k4_index(s, d):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return positions(load(s, d, "documents").select("doc_id", words.alias("terms")), "doc_id", "terms")


@query("k5_bm25", f"""WITH t AS ({TERMS}), len AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), tf AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN ('the','license','version') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
  SELECT doc_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/av))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), (SELECT count(*) AS n, avg(dl) AS av FROM len) GROUP BY 1""")
def k5(s, d):
    return bm25(load(s, d, "documents"), "doc_id", "text", ["the", "license", "version"]).select("doc_id", r6("score").alias("score"))


@query("k13_levenshtein", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS dist FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<b.n_nationkey")
def k13(s, d):
    n = load(s, d, "nation")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("name2"), "n_regionkey")
    return n.join(b, "n_regionkey").where("n_nationkey < b").select(F.col("n_nationkey").alias("a"), "b", F.levenshtein("n_name", "name2").alias("dist"))


@query("k15_facets", "SELECT lang, floor(n_chars/1000)*1000 AS bucket, count(*) AS n FROM documents GROUP BY 1, 2")
def k15(s, d):
    return load(s, d, "documents").groupBy("lang", (F.floor(F.col("n_chars") / 1000) * 1000).cast("double").alias("bucket")).agg(F.count("*").alias("n"))


@query("k20_decay", "SELECT event_id, round(exp(-pow(greatest(0, value-50), 2)/(2*400)), 6) AS gauss, round(greatest(0, 1-abs(value-50)/50), 6) AS linear FROM events")
def k20(s, d):
    v = F.col("value")
    return load(s, d, "events").select("event_id", r6(F.exp(-F.pow(F.greatest(F.lit(0.0), v - 50), F.lit(2)) / 800)).alias("gauss"), r6(F.greatest(F.lit(0.0), 1 - F.abs(v - 50) / 50)).alias("linear"))


@query("q4_title_lang", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title, regexp_matches(html, '<html[^>]* lang=') AS has_lang FROM pages")
def q4(s, d):
    return load(s, d, "pages").select("page_id", (F.regexp_extract("html", "<title>([^<]*)</title>", 1) != "").alias("has_title"), F.col("html").rlike("<html[^>]* lang=").alias("has_lang"))


@query("q2_images_without_alt", "SELECT page_id, len(regexp_extract_all(html, '<img[^>]*>')) AS images, len(regexp_extract_all(html, '<img[^>]* alt=[^>]*>')) AS with_alt FROM pages")
def q2(s, d):
    return load(s, d, "pages").select("page_id", F.regexp_count("html", F.lit("<img[^>]*>")).cast("long").alias("images"), F.regexp_count("html", F.lit("<img[^>]* alt=[^>]*>")).cast("long").alias("with_alt"))


@query("q6_heading_levels", "SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS h1, len(regexp_extract_all(html, '<h2[ >]')) AS h2, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def q6(s, d):
    n = lambda t: F.regexp_count("html", F.lit(f"<{t}[ >]")).cast("long")
    return load(s, d, "pages").select("page_id", n("h1").alias("h1"), n("h2").alias("h2"), n("p").alias("paragraphs"))
