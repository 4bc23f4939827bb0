"""ARIMA per series by two least-squares steps on sums of products, so that a series of any length is one row when it is solved."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Fixed value: below this t-value (with an intercept, at 5 %) a series is not taken for a random walk.
UNIT_ROOT = -2.86
RESULT = "d int, p int, q int, n long, intercept double, ar array<double>, ma array<double>, sigma2 double, aic double, next double"


def _sums(names: list[str]):
    """Sums of all products of the columns, as an array in rows of the upper triangle."""
    return F.array(*[F.sum(c(a) * c(b)) for i, a in enumerate(names) for b in names[i:]])


def _square(flat: list[float], n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = flat
    return out + np.triu(out, 1).T


def _least_squares(gram: np.ndarray, use: list[int]) -> tuple[np.ndarray, float]:
    """(coefficients of the columns `use`, squared error) for the last column of a table with these sums of products."""
    a, b, y = gram[np.ix_(use, use)], gram[use, -1], gram[-1, -1]
    x = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    return x, float(max(0.0, y - 2 * b @ x + x @ a @ x))


def arima(df: DataFrame, by: str, order: list[str], value: str, most_p: int = 2, most_q: int = 1, most_d: int = 1, long: int = 8) -> DataFrame:
    """(by, d, p, q, n, intercept, ar, ma, sigma2, aic, next) of the best model of each series, `next` being its forecast one step on.

    A series is differenced d times, d being the least of 0..most_d at which a Dickey-Fuller test finds no unit root (else most_d). Its errors are first taken
    from an autoregression of `long` lags, then the series is regressed on up to `most_p` of its own lags and `most_q` of those errors. Both steps are least squares
    on sums of products, added up per series in tasks; all orders are solved from the same sums, and the least Bayesian criterion wins (ties: the lower p, then q).

    Rows whose value is null are left out, rows without `by` too; of a series with fewer than 3 * long values nothing is returned. Ties in `order` are
    settled by the value. Only the windows for lags need a series in order; they stream over it.
    """
    w = Window.partitionBy("by").orderBy("_o", "z")
    z = df.where(c(by).isNotNull() & c(value).isNotNull()).select(c(by).alias("by"), F.struct(*order).alias("_o"), c(value).cast("double").alias("z"))
    levels = [z.withColumn("last", F.lit(0.0))]
    for _ in range(most_d):
        before = levels[-1]
        step = before.withColumn("_b", F.lag("z").over(w)).where("_b IS NOT NULL")
        levels.append(step.select("by", "_o", (c("z") - c("_b")).alias("z"), (c("last") + c("z")).alias("last")))
    # whether a level stays about its mean: the t-value of its changes against where they start from
    rooted = []
    for d, x in enumerate(levels[:-1]):
        step = c("z") - c("_b")
        r = F.try_divide(F.covar_pop(step, "_b"), F.stddev_pop(step) * F.stddev_pop("_b"))
        t = x.withColumn("_b", F.lag("z").over(w)).where("_b IS NOT NULL").groupBy("by").agg(r.alias("r"), F.count("*").alias("n"))
        steady = F.coalesce(F.nanvl(c("r"), F.lit(-1.0)), F.lit(-1.0))
        value_t = steady * F.sqrt((c("n") - 2) / F.greatest(1 - steady * steady, F.lit(1e-12)))
        rooted.append(t.select("by", F.when(value_t < UNIT_ROOT, d).alias("d")))
    keys = z.select("by").distinct()
    chosen = keys.withColumn("d", F.lit(0)) if not rooted else keys.join(reduce(DataFrame.unionByName, rooted).groupBy("by").agg(F.min("d").alias("d")), "by", "left").select("by", F.coalesce("d", F.lit(most_d)).alias("d"))
    series = reduce(DataFrame.unionByName, [x.join(chosen.where(c("d") == d), "by") for d, x in enumerate(levels)])
    lagged = series.select("by", "d", "_o", "z", "last", *[F.lag("z", k).over(w).alias(f"z{k}") for k in range(1, long + 1)])
    lags = [f"z{k}" for k in range(1, long + 1)]
    whole = lagged.where(f"z{long} IS NOT NULL").withColumn("one", F.lit(1.0))
    first = ["one", *lags, "z"]

    def solve_first(batches):
        for batch in batches:
            out = [_least_squares(_square(flat, len(first)), list(range(len(first) - 1)))[0].tolist() for flat in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["by", "long"])

    key = df.schema[by].dataType.simpleString()
    found = whole.groupBy("by").agg(_sums(first).alias("sums"), F.count("*").alias("n")).where(c("n") >= 2 * long).select("by", "sums").mapInArrow(solve_first, f"by {key}, long array<double>")
    error = c("z") - reduce(lambda s, k: s + F.get("long", F.lit(k)) * (c(f"z{k}") if k else F.lit(1.0)), range(1, long + 1), F.get("long", F.lit(0)))
    # errors begin where the long lags do
    rest = whole.join(found, "by").withColumn("e", error)
    rest = rest.select("by", "d", "_o", "one", "z", "last", *[f"z{k}" for k in range(1, most_p + 1)], "e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, most_q + 1)])
    rest = rest.where(f"e{most_q} IS NOT NULL") if most_q else rest
    second = ["one", *[f"z{k}" for k in range(1, most_p + 1)], *[f"e{k}" for k in range(1, most_q + 1)], "z"]
    tail = F.struct("_o", "z", "last", *[f"z{k}" for k in range(1, most_p + 1)], "e", *[f"e{k}" for k in range(1, most_q + 1)])
    sums = rest.groupBy("by", "d").agg(_sums(second).alias("sums"), F.count("*").alias("n"), F.max(tail).alias("t"))
    ends = F.array(c("t.z"), *[c(f"t.z{k}") for k in range(1, most_p + 1)], c("t.e"), *[c(f"t.e{k}") for k in range(1, most_q + 1)])

    def solve_second(batches):
        for batch in batches:
            rows = []
            for who, d, flat, n, last, end in zip(*[x.to_pylist() for x in batch.columns]):
                gram, best = _square(flat, len(second)), None
                for p in range(most_p + 1):
                    for q in range(most_q + 1):
                        use = [0, *range(1, p + 1), *range(most_p + 1, most_p + 1 + q)]
                        x, sse = _least_squares(gram, use)
                        fit = n * np.log(max(sse / n, 1e-300))
                        bic = fit + (len(use) + 1) * np.log(n)
                        if best is None or bic < best[0] - 1e-9:
                            best = (bic, p, q, x, sse / n, fit + 2 * (len(use) + 1))
                _, p, q, x, s2, aic = best
                ar, ma = x[1 : 1 + p], x[1 + p :]
                step = float(x[0] + ar @ np.array(end[:p]) + ma @ np.array(end[most_p + 1 : most_p + 1 + q]))
                rows.append({"by": who, "d": d, "p": p, "q": q, "n": n, "intercept": float(x[0]), "ar": ar.tolist(), "ma": ma.tolist(), "sigma2": s2, "aic": float(aic), "next": step + last})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([pa.field("by", batch.schema.field(0).type), *schema]))

    schema = pa.schema([("d", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("n", pa.int64()), ("intercept", pa.float64()), ("ar", pa.list_(pa.float64())), ("ma", pa.list_(pa.float64())), ("sigma2", pa.float64()), ("aic", pa.float64()), ("next", pa.float64())])
    out = sums.select("by", "d", "sums", "n", c("t.last").alias("last"), ends.alias("ends")).mapInArrow(solve_second, f"by {key}, {RESULT}")
    return out.withColumnRenamed("by", by)
