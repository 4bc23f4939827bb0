"""Quality rules, classification, masking, lineage and schemas; replicas and snapshots of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import condition


def check_rules(df: DataFrame, rules: list[tuple[str, str, dict]]) -> DataFrame:
    """(rule, category, checked, failed) of row rules (name, category, condition tree) in one pass; a condition that is null fails."""
    n = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category"), F.count("*").alias("checked"), F.count_if(~F.coalesce(condition(t), F.lit(False))).alias("failed")) for r, c, t in rules]
    return df.agg(F.array(*n).alias("x")).select(F.inline("x"))


def sample_failures(df: DataFrame, rules: list[tuple[str, str, dict]], key: str, k: int) -> DataFrame:
    """(rule, key) of the k failing rows of each rule with the smallest keys."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(condition(t), F.lit(False)), F.lit(r)) for r, _, t in rules]))
    rows = df.select(key, F.explode(failed).alias("rule"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy(key))).where(F.col("_n") <= k).select("rule", key)


def classify_columns(columns: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """(table, column, level): the level of the rule (priority, pattern of the column's name, level) of highest priority that fits; Internal if none does."""
    fits = F.array_compact(F.array(*[F.when(F.col("column").rlike(p), F.struct(F.lit(n).alias("p"), F.lit(level).alias("l"))) for n, p, level in rules]))
    return columns.select("table", "column", F.coalesce(F.array_max(fits)["l"], F.lit("Internal")).alias("level"))


def mask_email(c: Column) -> Column:
    """The first two letters of the name and the whole domain stay."""
    return F.concat(F.left(c, F.lit(2)), F.lit("***@"), F.substring_index(c, "@", -1))


def mask_digits(c: Column, keep: int) -> Column:
    """All digits but the last `keep` become *; other characters stay."""
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    chars = F.split(c, "")
    step = lambda s, x: F.when(x.rlike("[0-9]"), F.struct((s["n"] + 1).alias("n"), F.concat(s["t"], F.when(s["n"] < digits - keep, F.lit("*")).otherwise(x)).alias("t"))).otherwise(F.struct(s["n"].alias("n"), F.concat(s["t"], x).alias("t")))
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), step, lambda s: s["t"])


def tokenized(df: DataFrame, column: str, secret: str) -> tuple[DataFrame, DataFrame]:
    """`df` with `column` replaced by a stable token, and the vault (token, value) to undo it."""
    token = F.concat(F.lit("tok_"), F.left(F.sha2(F.concat(F.lit(secret), F.col(column)), 256), F.lit(16)))
    return df.withColumn(column, token), df.select(token.alias("token"), F.col(column).alias("value")).distinct()


def shuffled(df: DataFrame, column: str, key: str, seed: int = 7) -> DataFrame:
    """`df` with the values of `column` permuted over its rows.

    Rows are dealt into blocks by a hash of the key, and in each block the values are dealt anew in the order of another hash, so no block is larger than a few thousand rows.
    """
    block = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(1, df.count() // 2000)))
    w = Window.partitionBy("_b")
    a = df.withColumn("_b", block).withColumn("_n", F.row_number().over(w.orderBy(key)))
    v = a.select("_b", F.col(column).alias("_v"), key).withColumn("_n", F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed + 1)), key))).drop(key)
    return a.join(v, ["_b", "_n"]).withColumn(column, F.col("_v")).select(*df.columns)


def subject_extract(tables: list[tuple[str, DataFrame, str]], subject) -> DataFrame:
    """(table, row) with every row of one subject as JSON, from tables (name, rows, subject column)."""
    return reduce(DataFrame.unionByName, [df.where(F.col(c) == subject).select(F.lit(n).alias("table"), F.to_json(F.struct(*sorted(df.columns))).alias("row")) for n, df, c in tables])


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, change, compatible) between two column lists (column, type, nullable)."""
    j = before.select("column", F.col("type").alias("t1"), F.col("nullable").alias("n1")).join(after.select("column", F.col("type").alias("t2"), F.col("nullable").alias("n2")), "column", "full")
    wider = ((F.col("t1") == "int") & F.col("t2").isin("bigint", "double")) | ((F.col("t1") == "float") & (F.col("t2") == "double"))
    change = F.when(F.col("t1").isNull(), "added").when(F.col("t2").isNull(), "removed").when(F.col("t1") != F.col("t2"), "type").when(F.col("n1") != F.col("n2"), "nullability")
    fine = F.when(F.col("t1").isNull(), F.col("n2")).when(F.col("t2").isNull(), False).when(F.col("t1") != F.col("t2"), wider).otherwise(F.col("n2"))
    return j.select("column", change.alias("change"), fine.alias("compatible")).where("change IS NOT NULL")


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """(table, column, type, nullable) of a DataFrame's schema."""
    rows = [(table, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "table string, column string, type string, nullable boolean")


def hash_chain(entries: DataFrame, key: str, order: str, values: list[str], name: str = "hash") -> DataFrame:
    """`entries` with a hash that covers the entry's values and the previous entry's hash, per key; a fold in `order`."""
    w = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws("|", *[F.col(v).cast("string") for v in values]).alias("v"))))
    start = F.struct(F.lit("").alias("h"), F.expr("CAST(array() AS array<struct<o:bigint,h:string>>)").alias("out"))

    def step(s, r):
        h = F.sha2(F.concat(s["h"], F.lit("|"), r["v"]), 256)
        return F.struct(h.alias("h"), F.concat(s["out"], F.array(F.struct(r["o"].cast("long").alias("o"), h.alias("h")))).alias("out"))

    return entries.groupBy(key).agg(w.alias("rows")).select(key, F.inline(F.aggregate("rows", start, step, lambda s: s["out"]))).select(key, F.col("o").alias(order), F.col("h").alias(name))


def broken_links(entries: DataFrame, key: str, order: str, values: list[str], stored: str) -> DataFrame:
    """The entries whose stored hash is not that of their values and the stored hash before them, with `valid`."""
    before = F.coalesce(F.lag(stored).over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    again = F.sha2(F.concat(before, F.lit("|"), F.concat_ws("|", *[F.col(v).cast("string") for v in values])), 256)
    return entries.withColumn("valid", again == F.col(stored))


def content_digest(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by..., n, digest): rows and an order-free sum of row hashes, per group; two copies agree if both do."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("digest"))


def restored(full: DataFrame, changes: DataFrame, key: str, seq: str, upto) -> DataFrame:
    """The state of a table from a full copy and the changes (key, seq, op, values...) up to `upto`: the last change of a key counts, deletes remove it."""
    values = [c for c in full.columns if c != key]
    base = full.select(key, F.lit(-1).cast("long").alias(seq), F.lit("set").alias("op"), *values)
    some = changes.where(F.col(seq) <= upto).select(key, F.col(seq).cast("long").alias(seq), "op", *values)
    last = base.unionByName(some).groupBy(key).agg(F.max_by(F.struct("op", *values), seq).alias("s"))
    return last.where("s.op <> 'delete'").select(key, *[F.col(f"s.{v}").alias(v) for v in values])


def clock_order(a: Column, b: Column) -> Column:
    """Before, After, Equal or Concurrent of two vector clocks (map of replica to count)."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    le, ge = F.forall(both, lambda v: v["x"] <= v["y"]), F.forall(both, lambda v: v["x"] >= v["y"])
    return F.when(le & ge, "Equal").when(le, "Before").when(ge, "After").otherwise("Concurrent")
