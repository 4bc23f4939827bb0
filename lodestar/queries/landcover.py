"""Registered queries: unsupervised classes, mapping units and series models (families G and H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import arima as M
from ..operators import landcover as L
from ..registry import query

c = F.col
BANDS = ["red", "nir"]


def isodata_centres(s, d):
    return L.isodata(load(s, d, "fx_pixels"), BANDS, [(0.3, 0.3), (0.7, 0.7)], rounds=12, spread=0.2, near=0.15)


@query("h23_isodata")
def h23(s, d):
    """Pixels in the clusters that splitting and merging ends with."""
    return L.classified(load(s, d, "fx_pixels"), BANDS, isodata_centres(s, d)).select("scene", "r", "c", "class")


@query("g16_land_cover")
def g16(s, d):
    """Land cover of the first scene by its clusters, with a minimum mapping unit of six cells."""
    p = load(s, d, "fx_pixels").where("scene = 0")
    cells = L.classified(p, BANDS, isodata_centres(s, d)).select("r", "c", "class")
    return L.sieve(cells, 6)


@query("g22_arima")
def g22(s, d):
    """The best model of each kind of event's values, with orders up to (2, 1, 1)."""
    out = M.arima(load(s, d, "events"), "event_type", ["ts", "event_id"], "value")
    return out.select("event_type", "d", "p", "q", "n", F.round("intercept", 6).alias("intercept"), F.round("sigma2", 4).alias("sigma2"), F.round("next", 4).alias("next"))


@query("g22_first_order", """WITH z AS (SELECT event_type, value, lag(value) OVER w AS z1, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id, value)),
  g AS (SELECT event_type, count(*) AS n, regr_slope(value, z1) AS b, regr_intercept(value, z1) AS a, avg(value) AS m, var_pop(value) AS v, regr_r2(value, z1) AS r2 FROM z WHERE k > 8 GROUP BY 1)
  SELECT event_type, n, p, round(CASE p WHEN 1 THEN a ELSE m END, 6) AS intercept, round(CASE p WHEN 1 THEN b END, 6) AS slope, round(CASE p WHEN 1 THEN v*(1-r2) ELSE v END, 4) AS sigma2
  FROM (SELECT *, CASE WHEN n*ln(v*(1-r2))+3*ln(n) < n*ln(v)+2*ln(n)-1e-9 THEN 1 ELSE 0 END AS p FROM g)""")
def g22_first(s, d):
    """The same with one lag or none."""
    out = M.arima(load(s, d, "events"), "event_type", ["ts", "event_id"], "value", most_p=1, most_q=0, most_d=0)
    return out.select("event_type", "n", "p", F.round("intercept", 6).alias("intercept"), F.round(F.get("ar", F.lit(0)), 6).alias("slope"), F.round("sigma2", 4).alias("sigma2"))
