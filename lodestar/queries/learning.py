"""Registered queries: features, models, evaluation and drift (family G, the rest)."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoint import checkpoint_dir
from ..fixtures import load
from ..operators import learning as M
from ..registry import query

c = F.col
r4, r6 = (lambda x: F.round(x, 4)), (lambda x: F.round(x, 6))
GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id%4=0 THEN NULL ELSE value END AS v FROM events"


def gaps(s, d):
    return load(s, d, "events").select("event_id", "user_id", "ts", F.when(c("event_id") % 4 != 0, c("value")).alias("v"))


@query("g1_more_calendar", "SELECT event_id, minute(ts) AS mi, dayofyear(ts) AS doy, dayofweek(ts) IN (0, 6) AS weekend, week(ts) AS week FROM events")
def g1(s, d):
    return load(s, d, "events").select("event_id", F.minute("ts").alias("mi"), F.dayofyear("ts").alias("doy"), F.dayofweek("ts").isin(1, 7).alias("weekend"), F.weekofyear("ts").alias("week"))


@query("g2_cyclical", "SELECT event_id, round(cos(2*pi()*hour(ts)/24), 6) AS hc, round(sin(2*pi()*dayofweek(ts)/7), 6) AS ds, round(cos(2*pi()*month(ts)/12), 6) AS mc FROM events")
def g2(s, d):
    return load(s, d, "events").select("event_id", r6(F.cos(2 * math.pi * F.hour("ts") / 24)).alias("hc"), r6(F.sin(2 * math.pi * (F.dayofweek("ts") - 1) / 7)).alias("ds"), r6(F.cos(2 * math.pi * F.month("ts") / 12)).alias("mc"))


@query("g3_rolling_per_user", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 5) AS sd, min(value) OVER w AS least, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, CASE WHEN count(*) OVER w > 1 THEN round(regr_slope(value, n) OVER w, 5) END AS trend FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts)::DOUBLE AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def g3(s, d):
    e = M.lagged(load(s, d, "events"), ["user_id"], "ts", "value", 5)
    return e.select("event_id", r6("mean").alias("mean"), F.round("sd", 5).alias("sd"), "least", "before", F.round("trend", 5).alias("trend"))


@query("g4_region_features", "SELECT scene, r//20 AS region, round(avg(nir), 8) AS mean, round(var_pop(nir), 12) AS variance, max(nir)-min(nir) AS span, round(median(nir), 6) AS med, count(DISTINCT nir) AS levels FROM fx_pixels GROUP BY 1, 2")
def g4(s, d):
    g = load(s, d, "fx_pixels").groupBy("scene", F.expr("r div 20").alias("region"))
    return g.agg(F.round(F.avg("nir"), 8).alias("mean"), F.round(F.var_pop("nir"), 12).alias("variance"), (F.max("nir") - F.min("nir")).alias("span"), r6(F.median("nir")).alias("med"), F.count_distinct("nir").alias("levels"))


@query("g4_region_entropy", "SELECT scene, region, round(-sum(p*ln(p)), 6) AS entropy FROM (SELECT scene, region, n/sum(n) OVER (PARTITION BY scene, region) AS p FROM (SELECT scene, r//20 AS region, floor(nir*10) AS bin, count(*) AS n FROM fx_pixels GROUP BY 1, 2, 3)) GROUP BY 1, 2")
def g4_entropy(s, d):
    n = load(s, d, "fx_pixels").groupBy("scene", F.expr("r div 20").alias("region"), F.floor(c("nir") * 10).alias("bin")).agg(F.count("*").alias("n"))
    p = c("n") / F.sum("n").over(Window.partitionBy("scene", "region"))
    return n.withColumn("p", p).groupBy("scene", "region").agg(r6(-F.sum(c("p") * F.log("p"))).alias("entropy"))


@query("g5_robust_maxabs", "SELECT p_partkey, round((p_retailprice-med)/(q3-q1), 6) AS robust, round(p_retailprice/m, 6) AS maxabs, round((p_retailprice-med)/(q3-q1)*(q3-q1)+med, 4) AS back FROM part, (SELECT quantile_cont(p_retailprice, 0.25) AS q1, median(p_retailprice) AS med, quantile_cont(p_retailprice, 0.75) AS q3, max(abs(p_retailprice)) AS m FROM part)")
def g5(s, d):
    p = M.scaled(load(s, d, "part"), "p_retailprice", ["robust", "maxabs"])
    return p.select("p_partkey", r6("p_retailprice_robust").alias("robust"), r6("p_retailprice_maxabs").alias("maxabs"), r4("p_retailprice").alias("back"))


@query("g6_one_hot", "SELECT c_custkey, (c_mktsegment='AUTOMOBILE')::INT AS automobile, (c_mktsegment='BUILDING')::INT AS building, (c_mktsegment='MACHINERY')::INT AS machinery FROM customer")
def g6(s, d):
    return load(s, d, "customer").select("c_custkey", *[(c("c_mktsegment") == k.upper()).cast("int").alias(k) for k in ("automobile", "building", "machinery")])


@query("g7_impute", f"SELECT event_id, round(coalesce(v, m), 6) AS by_mean, round(coalesce(v, med), 6) AS by_median, coalesce(v, -1) AS by_constant FROM ({GAPS}), (SELECT avg(v) AS m, median(v) AS med FROM ({GAPS}))")
def g7(s, d):
    g = gaps(s, d).withColumn("a", c("v")).withColumn("b", c("v")).withColumn("k", c("v"))
    g = M.imputed(M.imputed(M.imputed(g, "a", "mean"), "b", "median"), "k", "constant", -1.0)
    return g.select("event_id", r6("a").alias("by_mean"), r6("b").alias("by_median"), c("k").alias("by_constant"))


@query("g8_fill_in_order", f"SELECT event_id, a AS forward, b AS backward, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NOT NULL AND b IS NOT NULL THEN a+(b-a)*(n-i)/(j-i) END, 6) AS linear FROM (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER q AS b, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER p AS i, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER q AS j FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM ({GAPS})) WINDOW p AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
def g8(s, d):
    return M.filled(gaps(s, d), ["user_id"], "ts", "v").select("event_id", c("v_forward").alias("forward"), c("v_backward").alias("backward"), r6("v_linear").alias("linear"))


@query("g9_knn_impute", "SELECT id, round(avg(value), 4) AS v FROM (SELECT q.id, p.value, row_number() OVER (PARTITION BY q.id ORDER BY sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)), p.id) AS n FROM fx_sites q, fx_points p) WHERE n <= 3 GROUP BY 1")
def g9(s, d):
    from ..operators.spatial import nearest

    have = load(s, d, "fx_points").select(c("id").alias("id2"), c("lon").alias("lon2"), c("lat").alias("lat2"), "value")
    return nearest(load(s, d, "fx_sites").select("id", "lon", "lat"), have, 3, 10.0).groupBy("id").agg(r4(F.avg("value")).alias("v"))


@query("g10_feature_operations", "SELECT p_partkey, p_size*p_size AS squared, round(p_size*p_retailprice, 4) AS crossed, round(ln(1+p_retailprice), 6) AS logged, round(sqrt(p_retailprice), 6) AS root, least(floor(p_size/10.0), 4)::INT AS bin FROM part")
def g10(s, d):
    z, p = c("p_size"), c("p_retailprice")
    return load(s, d, "part").select("p_partkey", (z * z).alias("squared"), r4(z * p).alias("crossed"), r6(F.log(1 + p)).alias("logged"), r6(F.sqrt(p)).alias("root"), F.least(F.floor(z / 10), F.lit(4)).cast("int").alias("bin"))


@query("g11_feature_selection", "SELECT 'p_size' AS feature, round(var_pop(p_size), 4) AS variance, round(abs(corr(p_size, p_retailprice)), 6) AS score FROM part UNION ALL SELECT 'p_partkey', round(var_pop(p_partkey), 4), round(abs(corr(p_partkey, p_retailprice)), 6) FROM part")
def g11(s, d):
    return load(s, d, "part").agg(F.array(*[F.struct(F.lit(k).alias("feature"), r4(F.var_pop(k)).alias("variance"), r6(F.abs(F.corr(k, "p_retailprice"))).alias("score")) for k in ("p_size", "p_partkey")]).alias("x")).select(F.inline("x"))


@query("g12_split")
def g12(s, d):
    p = load(s, d, "part")
    return p.select("p_partkey", F.when(M.folds(p, "p_partkey", 100) < 80, "train").otherwise("test").alias("part"))


@query("g14_linear_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def g14(s, d):
    y, x = "l_extendedprice", "l_quantity"
    return load(s, d, "lineitem").groupBy("l_returnflag").agg(r4(F.regr_slope(y, x)).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


@query("g15_random_forest")
def g15(s, d):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    p = load(s, d, "fx_pixels").withColumn("label", (c("nir") > c("red")).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["red", "green", "nir"], outputCol="x"), RandomForestClassifier(featuresCol="x", numTrees=8, maxDepth=5, seed=7)]).fit(p.where("scene = 0"))
    # kept where every machine can read it, as a registered model would be
    at = f"{checkpoint_dir(s)}/model-{uuid.uuid4().hex}"
    model.save(at)
    return PipelineModel.load(at).transform(p.where("scene = 1")).select("r", "c", "label", "prediction")


@query("g19_spatial_outliers", "SELECT p.id, round(abs(any_value(p.value)-avg(q.value)), 6) AS off, count(*) AS n FROM fx_points p JOIN fx_points q ON p.id<>q.id AND sqrt(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) <= 10 GROUP BY 1")
def g19(s, d):
    from ..operators.geostat import around

    g = around(load(s, d, "fx_points").select("id", "lon", "lat", "value"), 10.0)
    return g.select("id", r6(F.abs(c("value") - c("s") / F.nullif("k", F.lit(0.0)))).alias("off"), c("n").cast("long").alias("n"))


@query("g20_naive_forecast", "SELECT user_id, step, round(m, 6) AS value, round(m-1.96*sd, 5) AS low, round(m+1.96*sd, 5) AS high FROM (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n <= 5 GROUP BY 1), (SELECT unnest([1, 2, 3])::INT AS step)")
def g20(s, d):
    f = M.naive_forecast(load(s, d, "events"), "user_id", "ts", "value", 5, 3)
    return f.select("user_id", "step", r6("value").alias("value"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("g21_smoothing", "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), w AS (SELECT user_id, n, value AS level FROM o WHERE n=1 UNION ALL SELECT o.user_id, o.n, 0.3*o.value+0.7*w.level FROM w JOIN o ON o.user_id=w.user_id AND o.n=w.n+1) SELECT user_id, round(arg_max(level, n), 6) AS level FROM w GROUP BY 1")
def g21(s, d):
    return M.smoothed(load(s, d, "events"), "user_id", "ts", "value", 0.3).select("user_id", r6("level").alias("level"))


@query("g21_seasonal_naive", "SELECT day, n, lag(n, 7) OVER (ORDER BY day) AS forecast FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)")
def g21_seasonal(s, d):
    g = load(s, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return g.withColumn("forecast", F.lag("n", 7).over(Window.orderBy("day")))


@query("g22_autoregression", "SELECT user_id, round(regr_slope(value, before), 4) AS phi, round(regr_intercept(value, before), 3) AS base FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) GROUP BY 1 HAVING count(before) > 3")
def g22(s, d):
    e = load(s, d, "events").select("user_id", "value", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts")).alias("before"))
    g = e.groupBy("user_id").agg(r4(F.regr_slope("value", "before")).alias("phi"), F.round(F.regr_intercept("value", "before"), 3).alias("base"), F.count("before").alias("n"))
    return g.where("n > 3").drop("n")


@query("g23_confusion_normalised", "SELECT y_true, y_pred, round(count(*)/sum(count(*)) OVER (PARTITION BY y_true), 6) AS share FROM fx_predictions GROUP BY 1, 2")
def g23(s, d):
    n = load(s, d, "fx_predictions").groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    return n.select("y_true", "y_pred", r6(c("n") / F.sum("n").over(Window.partitionBy("y_true"))).alias("share"))


@query("g24_macro", "SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p+r > 0 THEN 2*p*r/(p+r) ELSE 0 END), 6) AS f1 FROM (SELECT k, coalesce(count(*) FILTER (WHERE y_true=k AND y_pred=k)/nullif(count(*) FILTER (WHERE y_pred=k), 0), 0) AS p, coalesce(count(*) FILTER (WHERE y_true=k AND y_pred=k)/nullif(count(*) FILTER (WHERE y_true=k), 0), 0) AS r FROM fx_predictions, (SELECT DISTINCT y_true AS k FROM fx_predictions UNION SELECT y_pred FROM fx_predictions) GROUP BY 1)")
def g24(s, d):
    return M.class_report(load(s, d, "fx_predictions"), "y_true", "y_pred").agg(*[r6(F.avg(k)).alias(k) for k in ("precision", "recall", "f1")])


@query("g25_regression_metrics", "SELECT round(avg(abs(t-p)), 6) AS mae, round(avg(pow(t-p,2)), 4) AS mse, round(sqrt(avg(pow(t-p,2))), 6) AS rmse, round(1-sum(pow(t-p,2))/(var_pop(t)*count(*)), 6) AS r2, round(sum(CASE WHEN t<>0 THEN abs(t-p)/abs(t) ELSE 0 END)/count(*)*100, 6) AS mape FROM (SELECT l_extendedprice AS t, l_quantity*1500 AS p FROM lineitem)")
def g25(s, d):
    r = M.regression_report(load(s, d, "lineitem").select(c("l_extendedprice").alias("t"), (c("l_quantity") * 1500).alias("p")), "t", "p")
    return r.select(r6("mae").alias("mae"), r4("mse").alias("mse"), r6("rmse").alias("rmse"), r6("r2").alias("r2"), r6("mape").alias("mape"))


@query("g26_folds", "SELECT doc_id, label, (row_number() OVER (PARTITION BY label ORDER BY doc_id)-1)%5 AS fold FROM (SELECT doc_id, quality AS label FROM labels)")
def g26(s, d):
    x = load(s, d, "labels").select("doc_id", c("quality").alias("label"))
    return x.withColumn("fold", ((F.row_number().over(Window.partitionBy("label").orderBy("doc_id")) - 1) % 5).cast("long"))


@query("g27_spatial_folds", "SELECT id, abs(floor(lon/30)::BIGINT*7+floor(lat/30)::BIGINT*3)%4 AS fold FROM fx_points")
def g27(s, d):
    return load(s, d, "fx_points").select("id", (F.abs(F.floor(c("lon") / 30) * 7 + F.floor(c("lat") / 30) * 3) % 4).alias("fold"))


@query("g28_batch_inference", "SELECT p_partkey, round(900+0.1*p_partkey+2*p_size, 4) AS predicted FROM part")
def g28(s, d):
    def predict(batches):  # a model is loaded once for all batches of a task
        weights = {"base": 900.0, "p_partkey": 0.1, "p_size": 2.0}
        for b in batches:
            yield b.assign(predicted=weights["base"] + weights["p_partkey"] * b["p_partkey"] + weights["p_size"] * b["p_size"])[["p_partkey", "predicted"]]

    return load(s, d, "part").select("p_partkey", "p_size").mapInPandas(predict, "p_partkey long, predicted double").select("p_partkey", r4("predicted").alias("predicted"))


@query("g30_drift", "SELECT round(sum((a-b)*ln(a/b)), 6) AS psi, round(sum((a*ln(2*a/(a+b))+b*ln(2*b/(a+b)))/2), 6) AS js, round(sum(pow(a-b,2)/b), 6) AS chi2, round(max(d), 6) AS ks, round(sum(d), 6) AS w1 FROM (SELECT *, abs(sum(a-b) OVER (ORDER BY bin)) AS d FROM (SELECT bin, (sum((k%2=0)::INT)+0.5)/(max(na)+5) AS a, (sum((k%2=1)::INT)+0.5)/(max(nb)+5) AS b FROM (SELECT event_id AS k, least(floor(value/100*10), 9) AS bin FROM events), (SELECT sum((event_id%2=0)::INT) AS na, sum((event_id%2=1)::INT) AS nb FROM events) GROUP BY 1))")
def g30(s, d):
    e = load(s, d, "events")
    x = M.drift(M.binned(e, c("value") / 100, c("event_id") % 2 == 0, 10))
    return x.select(*[r6(k).alias(k) for k in ("psi", "js", "chi2", "ks", "w1")])


@query("g31_feature_drift", "SELECT event_type AS feature, round(abs(avg(value) FILTER (WHERE event_id%2=0)-avg(value) FILTER (WHERE event_id%2=1)), 6) AS score FROM events GROUP BY 1")
def g31(s, d):
    half = lambda k: F.avg(F.when(c("event_id") % 2 == k, c("value")))
    return load(s, d, "events").groupBy(c("event_type").alias("feature")).agg(r6(F.abs(half(0) - half(1))).alias("score"))


@query("g32_model_performance", "SELECT event_type AS model, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg((value > 95)::INT), 6) AS errors, count(*) AS n FROM events GROUP BY 1")
def g32(s, d):
    return load(s, d, "events").groupBy(c("event_type").alias("model")).agg(*[r6(F.percentile("value", p)).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)], r6(F.avg((c("value") > 95).cast("int"))).alias("errors"), F.count("*").alias("n"))


@query("g33_model_registry", "SELECT user_id AS model, max(version) AS latest, arg_max(event_id, version) FILTER (WHERE value > 50) AS active FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version FROM events) GROUP BY 1")
def g33(s, d):
    e = load(s, d, "events").withColumn("version", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    return e.groupBy(c("user_id").alias("model")).agg(F.max("version").cast("long").alias("latest"), F.max_by(F.when(c("value") > 50, c("event_id")), F.when(c("value") > 50, c("version"))).alias("active"))


@query("g34_cosine_top_k", "SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])/(sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))*sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id<>v.vec_id WHERE q.vec_id%100=0) WHERE rank <= 5")
def g34(s, d):
    v = load(s, d, "embeddings")
    return M.cosine_top(v.where("vec_id % 100 = 0"), v, 5).select("query_id", "vec_id", c("rank").cast("long").alias("rank"))
