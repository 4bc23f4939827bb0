"""Declared pipelines over DataFrames, named functions, stage metrics and streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import DoubleType

from .relational import AGGREGATES, condition

#: One step of a declared pipeline by its kind: (DataFrame, settings) -> DataFrame.
STEPS: dict[str, Callable] = {
    "filter": lambda df, x: df.where(condition(x["where"])),
    "map": lambda df, x: df.withColumns({k: F.expr(v) for k, v in x["columns"].items()}),
    "select": lambda df, x: df.select(*x["columns"]),
    "group": lambda df, x: df.groupBy(*x["by"]).agg(*[AGGREGATES[a](F.col(f) if f != "*" else F.lit(1)).alias(n) for n, a, f in x["metrics"]]),
    "sort": lambda df, x: df.orderBy(*[F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, down in x["by"]]),
    "distinct": lambda df, x: df.dropDuplicates(x.get("by")),
    "limit": lambda df, x: df.limit(x["n"]),
    "rename": lambda df, x: df.withColumnsRenamed(x["names"]),
}


def validate(spec: dict) -> list[str]:
    """What is wrong with a declared pipeline, empty if nothing."""
    wrong = [] if "source" in spec else ["no source"]
    return wrong + [f"step {k}: unknown kind {x.get('kind')}" for k, x in enumerate(spec.get("steps", [])) if x.get("kind") not in STEPS]


def run_steps(source: DataFrame, spec: dict, observe: bool = False) -> tuple[DataFrame, list[Observation]]:
    """The source after the declared steps; with `observe`, an Observation of the rows after each, filled when the result is written."""
    wrong = validate(spec)
    if wrong:
        raise ValueError("; ".join(wrong))
    seen = []
    for k, step in enumerate(spec.get("steps", [])):
        source = STEPS[step["kind"]](source, step)
        if observe:
            seen.append(Observation(f"step {k} {step['kind']}"))
            source = source.observe(seen[-1], F.count(F.lit(1)).alias("rows"))
    return source, seen


def named(name: str, *columns: str):
    """A built-in or registered function by its name."""
    return F.call_function(name, *map(F.col, columns))


@F.pandas_udf(DoubleType())
def log1p_abs(x: pd.Series) -> pd.Series:
    """A vectorised scalar function."""
    import numpy as np

    return np.sign(x) * np.log1p(x.abs())


@F.pandas_udf(DoubleType())
def spread(x: pd.Series) -> float:
    """A vectorised aggregate: range over mean."""
    return float((x.max() - x.min()) / x.mean()) if len(x) and x.mean() else 0.0


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> StreamingQuery:
    """Write what a stream has now and stop; run again, it goes on where it stopped."""
    q = stream.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def late_tolerant_counts(stream: DataFrame, ts: str, late: str, window: str, key: str) -> DataFrame:
    """Counts per window and key; rows later than `late` behind the newest are dropped, and a window is given out once it is complete."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def once_per_key(stream: DataFrame, ts: str, keys: list[str], within: str) -> DataFrame:
    """The first row of a key in a stream; the key is forgotten `within` after the newest time."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def merge_into(path: str, key: str, order: str):
    """A function for foreachBatch: keeps the newest row of each key in versioned folders under `path`; a batch that comes again changes nothing."""
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={number - 1}"
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        last = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/v={number}")

    return put
