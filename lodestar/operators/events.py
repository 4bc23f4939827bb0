"""Operators over event logs, metrics and alerts: append checks, folds, gaps and islands, as-of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def append_check(log: DataFrame, batch: DataFrame, stream: str, expected: str) -> DataFrame:
    """The rows of `batch` with the stream's current version and an outcome: accepted or conflict.

    `expected` is a version, -1 for no such stream yet, -2 for any, -3 for a stream that must exist. Only the streams of the batch are counted in the log.
    """
    now = log.join(batch.select(stream).distinct(), stream, "left_semi").groupBy(stream).agg(F.count("*").alias("version"))
    v, e = F.coalesce("version", F.lit(0)), F.col(expected)
    fits = (e == -2) | ((e == -1) & (v == 0)) | ((e == -3) & (v > 0)) | ((e >= 0) & (e == v))
    return batch.join(now, stream, "left").withColumn("version", v.cast("long")).withColumn("outcome", F.when(fits, "accepted").otherwise("conflict"))


def as_of(log: DataFrame, key: str, order: str, at, values: list[str]) -> DataFrame:
    """Each key's last values at or before `at`, and how many rows led there."""
    return log.where(F.col(order) <= at).groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values], F.count("*").alias("version"))


def runs(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive rows of a key where `flag` holds: by..., first and last order value, the first value after it, rows."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.withColumn("_on", flag).withColumn("_new", (F.col("_on") != F.coalesce(F.lag("_on").over(w), ~F.col("_on"))).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(w)).withColumn("_next", F.lead(order).over(w))
    return numbered.where("_on").groupBy(*by, "_run").agg(F.min(order).alias("begin"), F.max(order).alias("last"), F.max("_next").alias("end"), F.count("*").alias("n")).drop("_run")


def by_gap(df: DataFrame, by: list[str], ts: str, seconds: float) -> DataFrame:
    """`df` with `series`: a row later than its predecessor of the key by more than `seconds` begins a new one."""
    w = Window.partitionBy(*by).orderBy(ts)
    return df.withColumn("series", F.sum(F.coalesce((micros(ts) - F.lag(micros(ts)).over(w) > seconds * 1e6).cast("int"), F.lit(0))).over(w))


def rolled_up(df: DataFrame, rules: list[tuple[str, str, str, str]], name: str = "name", ts: str = "ts", value: str = "value") -> DataFrame:
    """(rule, name, bucket, value) of roll-up rules (rule, name pattern with *, window, function), all from one pass over `df`.

    Every row is matched with the few rules in place; functions are Sum, Avg, Min, Max, Count, First, Last, Median, P95 and P99.
    """
    functions = {
        "Sum": F.sum(value), "Avg": F.avg(value), "Min": F.min(value), "Max": F.max(value), "Count": F.count(value).cast("double"), "First": F.min_by(value, ts), "Last": F.max_by(value, ts),
        "Median": F.median(value), "P95": F.percentile(value, 0.95), "P99": F.percentile(value, 0.99),
    }
    out = None
    for window in sorted({r[2] for r in rules}):
        mine = [r for r in rules if r[2] == window]
        used = [f for f in functions if f in {r[3] for r in mine}]
        agg = df.groupBy(F.col(name).alias("name"), F.window(ts, window).alias("w")).agg(*[functions[f].alias(f) for f in used])
        each = F.array(*[F.when(F.col("name").rlike("^" + r[1].replace("*", ".*") + "$"), F.struct(F.lit(r[0]).alias("rule"), F.col(r[3]).alias("value"))) for r in mine])
        part = agg.select("name", F.col("w.start").cast("timestamp_ntz").alias("bucket"), F.inline(F.array_compact(each)))
        out = part if out is None else out.unionByName(part)
    return out.select("rule", "name", "bucket", "value")


def token_bucket(df: DataFrame, key: str, ts: str, capacity: float, per_second: float) -> DataFrame:
    """Each row (event_id, key, ts) with `allowed`: whether the key's bucket, filled at `per_second` up to `capacity` over its whole history, still had a token for it.

    Rows are dealt by key and sorted by time and event_id, and one pass folds them with a level per key, so a history of any length needs no memory. Rows
    without a key share a bucket; rows without a time come first and fill nothing.
    """
    def run(batches):
        import pyarrow as pa

        who, level, last, begun = None, 0.0, None, False
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for k, t in zip(keys, times):
                if not begun or k != who:
                    who, level, last, begun = k, float(capacity), t, True
                elif t is not None:
                    level = min(float(capacity), level + (t - (last if last is not None else t)) / 1e6 * per_second)
                    last = t
                out.append(level >= 1)
                level -= level >= 1
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.bool_())], names=["id", "allowed"])

    rows = df.select(F.col(key).alias("k"), micros(ts).alias("t"), F.col("event_id").cast("long").alias("id"))
    return rows.repartition("k").sortWithinPartitions("k", "t", "id").mapInArrow(run, "id long, allowed boolean")
