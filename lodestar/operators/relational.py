"""Relational operators on top of the DataFrame API: builder filters, condition trees, top-n, keep-first, cubes, profiles."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)), "contains": lambda c, v: c.contains(v), "not_contains": lambda c, v: ~c.contains(v),
    "starts_with": lambda c, v: c.startswith(v), "ends_with": lambda c, v: c.endswith(v), "regex": lambda c, v: c.rlike(v),
    "is_null": lambda c, v: c.isNull(), "is_not_null": lambda c, v: c.isNotNull(), "between": lambda c, v: c.between(*v),
}
AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct, "median": F.median,
    "stddev": F.stddev, "variance": F.variance,
}


def condition(tree: dict[str, Any]) -> Column:
    """A boolean Column from {"and": [...]}, {"or": [...]}, {"not": tree} or {"field", "op", "value"}."""
    if "and" in tree:
        return reduce(lambda a, b: a & b, map(condition, tree["and"]), F.lit(True))
    if "or" in tree:
        return reduce(lambda a, b: a | b, map(condition, tree["or"]), F.lit(False))
    if "not" in tree:
        return ~condition(tree["not"])
    return OPERATORS[tree["op"]](F.col(tree["field"]), tree.get("value"))


def build(df: DataFrame, dimensions=(), metrics=(), filters=(), having=None, sort=(), limit=None, offset=0, time=None, derived=None) -> DataFrame:
    """A declared query as one DataFrame chain.

    metrics: (name, aggregate, field); time: (field, granularity, name); derived: {name: SQL expression over metrics};
    sort: (field, descending), nulls last in both directions.
    """
    for f in filters:
        df = df.where(condition(f))
    keys = [F.col(d) for d in dimensions] + ([F.date_trunc(time[1], F.col(time[0])).alias(time[2])] if time else [])
    if metrics:
        df = df.groupBy(*keys).agg(*[AGGREGATES[a](F.col(c) if c != "*" else F.lit(1)).alias(n) for n, a, c in metrics])
        for name, text in (derived or {}).items():
            df = df.withColumn(name, F.expr(text))
    elif keys:
        df = df.select(*keys).distinct()
    if having is not None:
        df = df.where(condition(having))
    if sort:
        df = df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in sort])
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of each group; Spark keeps at most n rows of a group per task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "_nth").drop("_nth")


def lookup(df: DataFrame, small: DataFrame, on: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Left join with a table of extra columns; it is broadcast only when its rows and their width have been counted to be small."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in small.columns), F.lit(16))
    size = small.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return df.join(F.broadcast(small) if size <= most_bytes else small, on, "left")


def profile(df: DataFrame) -> DataFrame:
    """Rows, distinct values, nulls, min and max of every column, in one pass: one row per column."""
    cols = df.columns
    one = df.agg(F.count("*").alias("n"), *[a for k, c in enumerate(cols) for a in (F.count_distinct(c).alias(f"d{k}"), F.sum(F.col(c).isNull().cast("long")).alias(f"z{k}"), F.min(c).cast("string").alias(f"l{k}"), F.max(c).cast("string").alias(f"h{k}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"d{k}").alias("n_distinct"), F.coalesce(f"z{k}", F.lit(0)).alias("n_null"), F.col(f"l{k}").alias("least"), F.col(f"h{k}").alias("most")) for k, c in enumerate(cols)])
    return one.select(F.inline(rows))


def equi_width(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket 0.., n, least, most) of equal-width buckets between the column's min and max."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        return df.select(F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("n"), F.col(column).alias("least"), F.col(column).alias("most")).limit(0)
    at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit((hi - lo) / buckets or 1.0)), F.lit(buckets - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))


def nearest_index(values: str | Column, p: float) -> Column:
    """The percentile at index floor(n * p) of the sorted values, cut to the last; an aggregate."""
    a = F.array_sort(F.collect_list(values))
    return F.get(a, F.least(F.floor(F.size(a) * F.lit(p)).cast("int"), F.size(a) - 1))


def islands(df: DataFrame, by: list[str], order: list[str], flag: Column, name: str = "island") -> DataFrame:
    """Rows where `flag` holds, numbered by run of consecutive such rows within a key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_on", flag).withColumn(name, F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "_on").orderBy(*order))).where("_on").drop("_on")


def sessions(df: DataFrame, by: list[str], ts: str, gap_seconds: float, name: str = "session") -> DataFrame:
    """Numbers the sessions of a key: a row later than its predecessor by more than the gap begins a new one."""
    w = Window.partitionBy(*by).orderBy(ts)
    late = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1e6
    return df.withColumn("_new", F.coalesce(late.cast("int"), F.lit(0))).withColumn(name, F.sum("_new").over(w)).drop("_new")


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) for keys added, modified or deleted between two tables of equal columns."""
    side = lambda df: df.select(F.col(key), F.xxhash64(*[c for c in sorted(df.columns) if c != key]).alias("h"))
    a, b = side(before).withColumnRenamed("h", "a"), side(after).withColumnRenamed("h", "b")
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Deleted").otherwise("Modified").alias("change"))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with `place`, 1 for the first row of the whole order, and so on; `order` should leave no ties.

    Rows are sorted into ranges by Spark's sampled range partitioning; counts per range give each row its place, so no task sees them all.
    """
    from ..checkpoint import durable

    rows = durable(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before, n = [], 0
    for p, size in sorted((r["_p"], r["count"]) for r in rows.groupBy("_p").count().collect()):  # a row per range
        before.append((p, n))
        n += size
    if not before:
        return rows.withColumn("place", F.lit(0).cast("long")).drop("_p")
    start = df.sparkSession.createDataFrame(before, "_p int, _start long")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(start), "_p").withColumn("place", F.col("_start") + F.col("_n")).drop("_p", "_n", "_start")


def equi_depth(df: DataFrame, column: str, tie: str, buckets: int) -> DataFrame:
    """(bucket 1.., n, least, most) of buckets with equal counts, the first ones one larger."""
    from ..checkpoint import durable

    rows = durable(placed(df.where(F.col(column).isNotNull()).select(column, tie), [F.col(column).asc(), F.col(tie).asc()]))
    n, place = rows.count(), F.col("place") - 1
    if not n:
        return rows.select(F.lit(1).alias("bucket"), F.lit(0).cast("long").alias("n"), F.col(column).alias("least"), F.col(column).alias("most")).limit(0)
    small, extra = divmod(n, buckets)
    wide = extra * (small + 1)
    bucket = F.when(place < wide, F.floor(place / (small + 1))).otherwise(extra + F.floor((place - wide) / max(1, small)))
    return rows.withColumn("bucket", (bucket + 1).cast("long")).groupBy("bucket").agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most"))
