"""Registered queries: governance, audit and replicas (families N, P and R, the rest)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import TABLES, load
from ..operators import governance as G
from ..operators import relational as R
from ..registry import query

r4, r6 = (lambda c: F.round(c, 4)), (lambda c: F.round(c, 6))
ntz = lambda c: c.cast("timestamp_ntz")
TS = lambda text: F.expr(f"TIMESTAMP_NTZ '{text}'")
leaf = lambda f, o, v=None: {"field": f, "op": o, "value": v}
RULES = [
    ("bal_not_negative", "Accuracy", leaf("c_acctbal", "gte", 0)), ("name_format", "Validity", leaf("c_name", "regex", "^Customer")), ("segment_known", "Validity", leaf("c_mktsegment", "in", ["BUILDING", "MACHINERY", "AUTOMOBILE"])),
    ("nation_there", "Completeness", leaf("c_nationkey", "is_not_null")), ("bal_range", "Accuracy", leaf("c_acctbal", "between", (-500, 9000))),
]
RULES_SQL = "SELECT unnest([struct_pack(rule := 'bal_not_negative', category := 'Accuracy', ok := c_acctbal >= 0), struct_pack(rule := 'name_format', category := 'Validity', ok := regexp_matches(c_name, '^Customer')), struct_pack(rule := 'segment_known', category := 'Validity', ok := c_mktsegment IN ('BUILDING','MACHINERY','AUTOMOBILE')), struct_pack(rule := 'nation_there', category := 'Completeness', ok := c_nationkey IS NOT NULL), struct_pack(rule := 'bal_range', category := 'Accuracy', ok := c_acctbal BETWEEN -500 AND 9000)], recursive := true), c_custkey FROM customer"


@query("n1_table_rules", "SELECT 'not_null' AS rule, count(*)-count(o_custkey) AS failed FROM orders UNION ALL SELECT 'row_count', CASE WHEN count(*) >= 1000 THEN 0 ELSE 1 END FROM orders UNION ALL SELECT 'freshness', CASE WHEN max(o_orderdate) >= TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END FROM orders UNION ALL SELECT 'custom', count(*) FILTER (WHERE o_totalprice < 0) FROM orders UNION ALL SELECT 'mean_price', CASE WHEN avg(o_totalprice) BETWEEN 1000 AND 500000 THEN 0 ELSE 1 END FROM orders")
def n1_table(s, d):
    bad = lambda ok: F.when(ok, 0).otherwise(1).cast("long")
    rules = {
        "not_null": F.count("*") - F.count("o_custkey"), "row_count": bad(F.count("*") >= 1000), "freshness": bad(F.max("o_orderdate") >= TS("1998-01-01")),
        "custom": F.count_if(F.expr("o_totalprice < 0")), "mean_price": bad(F.avg("o_totalprice").between(1000, 500000)),
    }
    return load(s, d, "orders").agg(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("failed")) for n, c in rules.items()]).alias("x")).select(F.inline("x"))


@query("n2_sample_failures", f"SELECT rule, c_custkey FROM (SELECT rule, c_custkey, row_number() OVER (PARTITION BY rule ORDER BY c_custkey) AS n FROM ({RULES_SQL}) WHERE NOT ok) WHERE n <= 3")
def n2(s, d):
    return G.sample_failures(load(s, d, "customer"), RULES, "c_custkey", 3)


@query("n3_scorecard", f"SELECT category, count(*) AS rules, count(*) FILTER (WHERE failed=0) AS passed, round(100*(1-sum(failed)/sum(checked)), 4) AS score FROM (SELECT rule, category, count(*) AS checked, count(*) FILTER (WHERE NOT ok) AS failed FROM ({RULES_SQL}) GROUP BY 1, 2) GROUP BY 1")
def n3(s, d):
    return G.check_rules(load(s, d, "customer"), RULES).groupBy("category").agg(F.count("*").alias("rules"), F.count_if(F.col("failed") == 0).alias("passed"), r4(100 * (1 - F.sum("failed") / F.sum("checked"))).alias("score"))


@query("n4_quality_trend", "SELECT m, score, round(score-lag(score) OVER (ORDER BY m), 4) AS change FROM (SELECT date_trunc('month', o_orderdate) AS m, round(100*avg((o_totalprice > 50000)::INT), 4) AS score FROM orders GROUP BY 1)")
def n4(s, d):
    g = load(s, d, "orders").groupBy(ntz(F.date_trunc("month", "o_orderdate")).alias("m")).agg(r4(100 * F.avg((F.col("o_totalprice") > 50000).cast("int"))).alias("score"))
    return g.withColumn("change", r4(F.col("score") - F.lag("score").over(Window.orderBy("m"))))


LEVELS = [(10, "bal|price|cost", "Confidential"), (20, "name|text", "Restricted"), (5, "key|id", "Internal"), (1, ".*", "Public")]


def all_columns(s, d):
    out = None
    for t in TABLES:
        part = G.columns_of(load(s, d, t), t)
        out = part if out is None else out.unionByName(part)
    return out


@query("n5_classification", "SELECT table_name AS \"table\", column_name AS \"column\", CASE WHEN regexp_matches(column_name, 'name|text') THEN 'Restricted' WHEN regexp_matches(column_name, 'bal|price|cost') THEN 'Confidential' WHEN regexp_matches(column_name, 'key|id') THEN 'Internal' ELSE 'Public' END AS level FROM duckdb_columns() WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations')")
def n5(s, d):
    return G.classify_columns(all_columns(s, d), LEVELS)


@query("n6_allowed_operations", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'Restricted' WHEN o_orderpriority LIKE '2%' THEN 'Confidential' ELSE 'Public' END AS level, NOT (o_orderpriority LIKE '1%') AS may_export, NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS may_share FROM orders")
def n6(s, d):
    level = F.when(F.col("o_orderpriority").startswith("1"), "Restricted").when(F.col("o_orderpriority").startswith("2"), "Confidential").otherwise("Public")
    matrix = F.create_map(F.lit("Restricted"), F.array(F.lit("read")), F.lit("Confidential"), F.array(F.lit("read"), F.lit("export")), F.lit("Public"), F.array(F.lit("read"), F.lit("export"), F.lit("share")))
    may = lambda what: F.array_contains(matrix[F.col("level")], what)
    return load(s, d, "orders").select("o_orderkey", level.alias("level")).select("o_orderkey", "level", may("export").alias("may_export"), may("share").alias("may_share"))


@query("n7_nullify", "SELECT c_custkey, '[REDACTED]' AS redacted, NULL::VARCHAR AS nulled FROM customer")
def n7(s, d):
    return load(s, d, "customer").select("c_custkey", F.lit("[REDACTED]").alias("redacted"), F.lit(None).cast("string").alias("nulled"))


@query("n9_format_preserving", "SELECT c_custkey, left(mail, 2) || '***@' || split_part(mail, '@', 2) AS email, '***-***-' || right(phone, 4) AS phone FROM (SELECT c_custkey, lower(replace(c_name, '#', '')) || '@example.com' AS mail, lpad((c_custkey%1000)::VARCHAR, 3, '0') || '-' || '555' || '-' || lpad((c_custkey*7%10000)::VARCHAR, 4, '0') AS phone FROM customer)")
def n9(s, d):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    k = F.col("c_custkey")
    c = load(s, d, "customer").select("c_custkey", F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")).alias("mail"), F.concat(pad(k % 1000, 3), F.lit("-555-"), pad(k * 7 % 10000, 4)).alias("phone"))
    return c.select("c_custkey", G.mask_email(F.col("mail")).alias("email"), G.mask_digits(F.col("phone"), 4).alias("phone"))


@query("n10_tokenization", "SELECT c.c_custkey, 'tok_' || left(sha256('pepper' || c_name), 16) AS c_name, c_name AS value FROM customer c")
def n10(s, d):
    masked, vault = G.tokenized(load(s, d, "customer").select("c_custkey", "c_name"), "c_name", "pepper")
    return masked.join(vault, masked["c_name"] == vault["token"]).select("c_custkey", "c_name", "value")


@query("n11_substitution", "SELECT c_custkey, ['Alder','Birch','Cedar','Elm'][('0x'||left(md5(c_name), 6))::INT%4+1] AS name FROM customer")
def n11(s, d):
    n = F.conv(F.left(F.md5(F.col("c_name").cast("binary")), F.lit(6)), 16, 10).cast("int") % 4 + 1
    return load(s, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("Alder", "Birch", "Cedar", "Elm"))), n).alias("name"))


@query("n12_generalization", "SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y, strftime(o_orderdate, '%Y-%m') AS m, (floor(o_totalprice/10000)*10000)::BIGINT || '-' || (floor(o_totalprice/10000)*10000+9999)::BIGINT AS band FROM orders")
def n12(s, d):
    lo = (F.floor(F.col("o_totalprice") / 10000) * 10000).cast("long")
    return load(s, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y"), F.date_format("o_orderdate", "yyyy-MM").alias("m"), F.concat(lo.cast("string"), F.lit("-"), (lo + 9999).cast("string")).alias("band"))


@query("n13_shuffle_column")
def n13(s, d):
    return G.shuffled(load(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


# Shapes of personal data and of secrets in text.
SHAPES = {"phones": r"[+]?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -][0-9]{3,4}", "cards": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", "keys": r"(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{16,}"}


@query("n14_personal_and_secrets", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT AS {n}" for n, p in SHAPES.items()) + " FROM documents")
def n14(s, d):
    return load(s, d, "documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in SHAPES.items()])


@query("n15_field_encryption", "SELECT c_custkey, c_name AS decrypted, sha256('index-key' || c_name) AS search_hash FROM customer")
def n15(s, d):
    key = F.lit("0123456789abcdef").cast("binary")
    sealed = load(s, d, "customer").select("c_custkey", F.aes_encrypt("c_name", key, F.lit("GCM")).alias("sealed"), F.sha2(F.concat(F.lit("index-key"), "c_name"), 256).alias("search_hash"))
    return sealed.select("c_custkey", F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string").alias("decrypted"), "search_hash")


@query("n16_tenant_filter", "SELECT o_orderkey, o_custkey%20 AS tenant, c_nationkey%20 <> o_custkey%20 AS mixed FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_custkey%20 IN (3, 7)")
def n16(s, d):
    o = load(s, d, "orders").withColumn("tenant", F.col("o_custkey") % 20).where(F.col("tenant").isin(3, 7))
    return o.join(load(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "tenant", (F.col("c_nationkey") % 20 != F.col("tenant")).alias("mixed"))


@query("n17_retention_policies", "SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN make_date(year(o_orderdate)+2, 12, 31) WHEN 1 THEN (o_orderdate + INTERVAL 90 DAY)::DATE ELSE (o_orderdate + INTERVAL 30 DAY)::DATE END AS expires, o_orderkey%50=0 AS held, CASE o_orderkey%3 WHEN 0 THEN make_date(year(o_orderdate)+2, 12, 31) WHEN 1 THEN (o_orderdate + INTERVAL 90 DAY)::DATE ELSE (o_orderdate + INTERVAL 30 DAY)::DATE END < DATE '1996-01-01' AND o_orderkey%50<>0 AS expired FROM orders")
def n17(s, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    end = F.when(k % 3 == 0, F.make_date(F.year(at) + 2, F.lit(12), F.lit(31))).when(k % 3 == 1, F.date_add(at.cast("date"), 90)).otherwise(F.date_add(at.cast("date"), 30))
    return load(s, d, "orders").select("o_orderkey", end.alias("expires"), (k % 50 == 0).alias("held"), ((end < F.lit("1996-01-01").cast("date")) & (k % 50 != 0)).alias("expired"))


@query("n18_expire_actions", "SELECT action, count(*) AS n, round(sum(price), 2) AS total FROM (SELECT CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'keep' WHEN o_orderstatus='F' THEN 'delete' WHEN o_orderstatus='O' THEN 'archive' ELSE 'anonymize' END AS action, o_totalprice AS price FROM orders) GROUP BY 1")
def n18(s, d):
    st = F.col("o_orderstatus")
    action = F.when(F.col("o_orderdate") >= TS("1996-01-01"), "keep").when(st == "F", "delete").when(st == "O", "archive").otherwise("anonymize")
    return load(s, d, "orders").groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("n19_subject_request", "SELECT 'customer' AS \"table\", count(*) AS n FROM customer WHERE c_custkey=7 HAVING count(*) > 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey=7 HAVING count(*) > 0 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id=7 HAVING count(*) > 0")
def n19(s, d):
    got = G.subject_extract([("customer", load(s, d, "customer"), "c_custkey"), ("orders", load(s, d, "orders"), "o_custkey"), ("events", load(s, d, "events"), "user_id")], 7)
    return got.groupBy("table").agg(F.count("row").alias("n"))


@query("n19_erasure", "SELECT event_id, CASE WHEN user_id%10=7 THEN NULL ELSE user_id END AS user_id FROM events")
def n19_erase(s, d):
    gone = load(s, d, "customer").where("c_custkey % 10 = 7").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("gone"))
    extra = load(s, d, "events").where("user_id % 10 = 7").select("user_id", F.lit(True).alias("gone"))
    gone = gone.unionByName(extra).distinct()
    return load(s, d, "events").join(gone, "user_id", "left").select("event_id", F.when(F.col("gone").isNull(), F.col("user_id")).alias("user_id"))


@query("n20_consent_at", "SELECT user_id, event_type AS purpose, arg_max(value, ts) >= 50 AS granted FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2 HAVING max(ts) + INTERVAL 15 DAY > TIMESTAMP '2024-01-20'")
def n20(s, d):
    g = load(s, d, "events").where(F.col("ts") <= TS("2024-01-20")).groupBy("user_id", F.col("event_type").alias("purpose")).agg(F.max_by("value", "ts").alias("v"), F.max("ts").alias("at"))
    return g.where(F.col("at") + F.expr("INTERVAL 15 DAYS") > TS("2024-01-20")).select("user_id", "purpose", (F.col("v") >= 50).alias("granted"))


@query("n21_control_score", "SELECT o_orderpriority AS framework, round(100*avg((o_orderstatus='F')::INT), 4) AS score, count(*) FILTER (WHERE o_orderstatus<>'F' AND o_orderdate < TIMESTAMP '1995-01-01') AS overdue FROM orders GROUP BY 1")
def n21(s, d):
    done = F.col("o_orderstatus") == "F"
    return load(s, d, "orders").groupBy(F.col("o_orderpriority").alias("framework")).agg(r4(100 * F.avg(done.cast("int"))).alias("score"), F.count_if(~done & (F.col("o_orderdate") < TS("1995-01-01"))).alias("overdue"))


@query("n22_lineage_counts", "SELECT src, count(*) AS sinks, max(dst) AS last_dst FROM fx_tree GROUP BY 1")
def n22(s, d):
    return load(s, d, "fx_tree").groupBy("src").agg(F.count("*").alias("sinks"), F.max("dst").alias("last_dst"))


@query("n23_upstream", "WITH RECURSIVE w(origin, node, hops) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT w.origin, e.src, hops+1 FROM w JOIN fx_tree e ON e.dst=w.node) SELECT origin, node, hops FROM w")
def n23(s, d):
    from ..operators.graph import reach

    return reach(load(s, d, "fx_tree"), load(s, d, "supplier").select(F.col("s_suppkey").alias("origin")), backward=True)


@query("n24_impact_risk", "WITH RECURSIVE w(origin, node) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION ALL SELECT w.origin, e.dst FROM w JOIN fx_tree e ON e.src=w.node) SELECT origin, count(*)-1 AS dependants, CASE WHEN count(*) > 20 THEN 'critical' WHEN count(*) > 6 THEN 'high' WHEN count(*) > 1 THEN 'medium' ELSE 'low' END AS risk FROM w GROUP BY 1")
def n24(s, d):
    from ..operators.graph import reach

    g = reach(load(s, d, "fx_tree"), load(s, d, "supplier").select(F.col("s_suppkey").alias("origin"))).groupBy("origin").agg(F.count("*").alias("n"))
    n = F.col("n")
    return g.select("origin", (n - 1).alias("dependants"), F.when(n > 20, "critical").when(n > 6, "high").when(n > 1, "medium").otherwise("low").alias("risk"))


@query("n25_schema_changes")
def n25(s, d):
    before = G.columns_of(load(s, d, "orders"), "orders")
    after = G.columns_of(load(s, d, "orders").drop("o_orderpriority").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("o_note", F.lit("x")), "orders")
    return G.schema_changes(before, after)


@query("n26_schema_versions", "SELECT user_id%20 AS subject, max(version) AS latest, count(*) AS versions, count(*) FILTER (WHERE event_type='error') AS deprecated FROM (SELECT *, row_number() OVER (PARTITION BY user_id%20 ORDER BY ts) AS version FROM events) GROUP BY 1")
def n26(s, d):
    e = load(s, d, "events").withColumn("subject", F.col("user_id") % 20).withColumn("version", F.row_number().over(Window.partitionBy("subject").orderBy("ts")))
    return e.groupBy("subject").agg(F.max("version").cast("long").alias("latest"), F.count("*").alias("versions"), F.count_if(F.col("event_type") == "error").alias("deprecated"))


@query("n27_merged_schemas", "SELECT c_custkey::DOUBLE AS k, c_name AS name, c_acctbal AS bal, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_retailprice FROM part")
def n27(s, d):
    a = load(s, d, "customer").select(F.col("c_custkey").cast("double").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = load(s, d, "part").select(F.col("p_partkey").cast("double").alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@query("n28_catalog_counts", "SELECT lang AS domain, source AS owner, count(*) AS n FROM documents WHERE lang IN ('en','de') AND n_chars > 200 GROUP BY 1, 2")
def n28(s, d):
    return load(s, d, "documents").where(F.col("lang").isin("en", "de") & (F.col("n_chars") > 200)).groupBy(F.col("lang").alias("domain"), F.col("source").alias("owner")).agg(F.count("*").alias("n"))


@query("n29_glossary", "SELECT p_partkey, 2*(p_type ILIKE '%brass%')::INT + (p_name ILIKE '%1%')::INT AS score, (SELECT count(*) FROM part q WHERE q.p_brand=p.p_brand) AS related FROM part p WHERE p_type ILIKE '%brass%' OR p_name ILIKE '%1%'")
def n29(s, d):
    p = load(s, d, "part")
    score = 2 * F.col("p_type").ilike("%brass%").cast("int") + F.col("p_name").ilike("%1%").cast("int")
    return p.withColumn("score", score).where("score > 0").join(p.groupBy("p_brand").agg(F.count("*").alias("related")), "p_brand").select("p_partkey", "score", "related")


@query("n30_stewardship", "SELECT o_custkey%50 AS steward, count(*) FILTER (WHERE o_orderstatus='O') AS open, count(*) FILTER (WHERE o_orderstatus='F') AS done, round(avg(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)) FILTER (WHERE o_orderstatus='F'), 4) AS mean_days, count(*) FILTER (WHERE o_orderstatus='O' AND o_orderdate < TIMESTAMP '1996-01-01') AS overdue FROM orders GROUP BY 1")
def n30(s, d):
    st = F.col("o_orderstatus")
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return load(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("steward")).agg(F.count_if(st == "O").alias("open"), F.count_if(st == "F").alias("done"), r4(F.avg(F.when(st == "F", days))).alias("mean_days"), F.count_if((st == "O") & (F.col("o_orderdate") < TS("1996-01-01"))).alias("overdue"))


@query("n31_json_columns", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS distinct_values, round(1-count(DISTINCT props)/count(*), 6) AS duplicate_rate, sum(len(props))::BIGINT AS chars, max(len(json_keys(props)))::BIGINT AS keys FROM events GROUP BY 1")
def n31(s, d):
    g = load(s, d, "events").groupBy("event_type")
    return g.agg(F.count("*").alias("n"), F.count_distinct("props").alias("distinct_values"), r6(1 - F.count_distinct("props") / F.count("*")).alias("duplicate_rate"), F.sum(F.length("props")).alias("chars"), F.max(F.size(F.json_object_keys("props"))).cast("long").alias("keys"))


@query("n33_chunks", "SELECT sha256(substr(text, (k*500+1)::INT, 500)) AS h, count(*) AS refs FROM documents, range(0, 1000) t(k) WHERE k*500 < length(text) GROUP BY 1")
def n33(s, d):
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500).cast("int")))
    parts = load(s, d, "documents").where(F.length("text") > 0).select("text", at.alias("k")).select(F.sha2(F.substring("text", F.col("k") * 500 + 1, F.lit(500)).cast("binary"), 256).alias("h"))
    return parts.groupBy("h").agg(F.count("*").alias("refs"))


@query("n34_narrowing", "SELECT 'l_linenumber' AS \"column\", CASE WHEN min(l_linenumber) >= -128 AND max(l_linenumber) <= 127 THEN 'tinyint' WHEN max(l_linenumber) <= 32767 THEN 'smallint' ELSE 'int' END AS advice FROM lineitem UNION ALL SELECT 'l_orderkey', CASE WHEN max(l_orderkey) <= 127 THEN 'tinyint' WHEN max(l_orderkey) <= 32767 THEN 'smallint' WHEN max(l_orderkey) <= 2147483647 THEN 'int' ELSE 'bigint' END FROM lineitem")
def n34(s, d):
    def advice(c):
        lo, hi = F.min(c), F.max(c)
        fits = lambda bits: (lo >= -(1 << bits - 1)) & (hi < 1 << bits - 1)
        return F.struct(F.lit(c).alias("column"), F.when(fits(8), "tinyint").when(fits(16), "smallint").when(fits(32), "int").otherwise("bigint").alias("advice"))

    return load(s, d, "lineitem").agg(F.array(advice("l_linenumber"), advice("l_orderkey")).alias("x")).select(F.inline("x"))


@query("p1_audit_query", "SELECT id, ts, action FROM fx_audit WHERE resource IN (1, 2, 3) AND result='Failure' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC LIMIT 50")
def p1(s, d):
    a = load(s, d, "fx_audit").where(F.col("resource").isin(1, 2, 3) & (F.col("result") == "Failure") & (F.col("ts") >= TS("2024-01-05")))
    return a.orderBy(F.desc("ts")).limit(50).select("id", "ts", "action")


@query("p3_access_pattern", "SELECT resource, count(*) AS n, count(DISTINCT actor) AS actors, min(ts) AS first_ts, max(ts) AS last_ts, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM fx_audit GROUP BY 1")
def p3(s, d):
    return load(s, d, "fx_audit").groupBy("resource").agg(F.count("*").alias("n"), F.count_distinct("actor").alias("actors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


@query("p4_chain_check", """WITH RECURSIVE o AS (SELECT id, actor, action, row_number() OVER (PARTITION BY actor ORDER BY id) AS n FROM fx_audit), w(actor, n, id, h) AS (SELECT actor, n, id, sha256('|' || id || '|' || action) FROM o WHERE n = 1 UNION ALL SELECT o.actor, o.n, o.id, sha256(w.h || '|' || o.id || '|' || o.action) FROM w JOIN o ON o.actor=w.actor AND o.n=w.n+1)
  SELECT id, h AS hash, coalesce(sha256(lag(h) OVER p || '|' || id || '|' || a), sha256('|' || id || '|' || a)) = h AS valid FROM (SELECT w.id, w.actor, w.h, CASE WHEN w.id%100=42 THEN 'tampered' ELSE x.action END AS a FROM w JOIN fx_audit x ON x.id=w.id) WINDOW p AS (PARTITION BY actor ORDER BY id)""")
def p4(s, d):
    a = load(s, d, "fx_audit").select("id", "actor", "action")
    stored = a.join(G.hash_chain(a, "actor", "id", ["id", "action"]), ["actor", "id"])
    changed = stored.withColumn("action", F.when(F.col("id") % 100 == 42, "tampered").otherwise(F.col("action")))
    return G.broken_links(changed, "actor", "id", ["id", "action"], "hash").select("id", "hash", "valid")


@query("p5_access_rate", "SELECT actor, date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (WHERE result='Failure') AS failures, count(*) FILTER (WHERE result='Failure') > 5 AS brute_force, count(*) > 3 AS fast FROM fx_audit GROUP BY 1, 2")
def p5(s, d):
    bad = F.count_if(F.col("result") == "Failure")
    return load(s, d, "fx_audit").groupBy("actor", ntz(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("n"), bad.alias("failures"), (bad > 5).alias("brute_force"), (F.count("*") > 3).alias("fast"))


# Patterns of attacks in request text, by family.
ATTACKS = {"sql": r"(?i)(union\s+select|or\s+1=1|drop\s+table)", "xss": r"(?i)(<script|javascript:|onerror=)", "path": r"(\.\./|%2e%2e)", "command": r"(;\s*(rm|cat|wget)\s|\$\()"}


@query("p6_attack_patterns", "SELECT page_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{n}' END" for n, p in ATTACKS.items()) + "], lambda x: x IS NOT NULL)) AS rule FROM pages")
def p6(s, d):
    hits = F.array_compact(F.array(*[F.when(F.col("html").rlike(p), F.lit(n)) for n, p in ATTACKS.items()]))
    return load(s, d, "pages").select("page_id", F.explode(hits).alias("rule"))


@query("p7_effective_permissions", "WITH RECURSIVE w(role, base) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION ALL SELECT w.role, e.src FROM w JOIN fx_tree e ON e.dst=w.base) SELECT role, count(DISTINCT base%7) AS permissions, bool_or('doc:'||(base%7)||':read' LIKE 'doc:3:%') AS may_read_3 FROM w GROUP BY 1")
def p7(s, d):
    from ..operators.graph import reach

    roles = reach(load(s, d, "fx_tree"), load(s, d, "supplier").select(F.col("s_suppkey").alias("origin")), backward=True)
    grant = F.concat(F.lit("doc:"), (F.col("node") % 7).cast("string"), F.lit(":read"))
    return roles.groupBy(F.col("origin").alias("role")).agg(F.count_distinct(F.col("node") % 7).alias("permissions"), F.bool_or(grant.like("doc:3:%")).alias("may_read_3"))


@query("p8_policy_decisions", "SELECT id, CASE WHEN action='error' OR (resource=13 AND actor%2=1) THEN 'deny' WHEN action IN ('view','click') OR (actor%10=0 AND hour(ts) BETWEEN 8 AND 18) THEN 'allow' ELSE 'deny' END AS decision FROM fx_audit")
def p8(s, d):
    a = load(s, d, "fx_audit").withColumn("odd", F.col("actor") % 2).withColumn("tenth", F.col("actor") % 10).withColumn("hour", F.hour("ts"))
    deny = R.condition({"or": [leaf("action", "eq", "error"), {"and": [leaf("resource", "eq", 13), leaf("odd", "eq", 1)]}]})
    allow = R.condition({"or": [leaf("action", "in", ["view", "click"]), {"and": [leaf("tenth", "eq", 0), leaf("hour", "between", (8, 18))]}]})
    return a.select("id", F.when(deny, "deny").when(allow, "allow").otherwise("deny").alias("decision"))


@query("p9_risk_score", "SELECT actor, least(100, greatest(0, 40*fail+30*night+30*least(1, n/20)))::DOUBLE AS score FROM (SELECT actor, avg((result='Failure')::INT) AS fail, avg((hour(ts) < 6)::INT) AS night, count(*) AS n FROM fx_audit GROUP BY 1)")
def p9(s, d):
    g = load(s, d, "fx_audit").groupBy("actor").agg(F.avg((F.col("result") == "Failure").cast("int")).alias("fail"), F.avg((F.hour("ts") < 6).cast("int")).alias("night"), F.count("*").alias("n"))
    score = 40 * F.col("fail") + 30 * F.col("night") + 30 * F.least(F.lit(1.0), F.col("n") / 20)
    return g.select("actor", F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).alias("score"))


@query("r2_multi_value", "SELECT k, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT k, replica, seq, value, rank() OVER (PARTITION BY k ORDER BY seq//100 DESC) AS x FROM fx_replica_log) WHERE x = 1 GROUP BY 1")
def r2_register(s, d):
    log = load(s, d, "fx_replica_log").withColumn("epoch", F.expr("seq div 100"))
    newest = log.groupBy("k").agg(F.max("epoch").alias("epoch"))
    return log.join(newest, ["k", "epoch"], "left_semi").groupBy("k").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("r3_pn_counter", "SELECT k, round(sum(p)-sum(m), 4) AS value FROM (SELECT k, replica, coalesce(max(value) FILTER (WHERE op='set'), 0) AS p, coalesce(max(value) FILTER (WHERE op='remove'), 0) AS m FROM fx_replica_log GROUP BY 1, 2) GROUP BY 1")
def r3(s, d):
    most = lambda op: F.coalesce(F.max(F.when(F.col("op") == op, F.col("value"))), F.lit(0.0))
    g = load(s, d, "fx_replica_log").groupBy("k", "replica").agg(most("set").alias("p"), most("remove").alias("m"))
    return g.groupBy("k").agg(r4(F.sum("p") - F.sum("m")).alias("value"))


@query("r4_sets", "SELECT a.k, count(DISTINCT a.seq%50) FILTER (WHERE r.tag IS NULL) AS or_set, count(DISTINCT a.seq%50) FILTER (WHERE t.e IS NULL) AS two_phase FROM fx_replica_log a LEFT JOIN (SELECT DISTINCT k, seq%97 AS tag FROM fx_replica_log WHERE op='remove') r ON r.k=a.k AND r.tag=a.seq%97 LEFT JOIN (SELECT DISTINCT k, seq%50 AS e FROM fx_replica_log WHERE op='remove') t ON t.k=a.k AND t.e=a.seq%50 WHERE a.op='set' GROUP BY a.k")
def r4_sets(s, d):
    log = load(s, d, "fx_replica_log").select("k", (F.col("seq") % 97).alias("tag"), (F.col("seq") % 50).alias("e"), "op")
    gone = log.where("op = 'remove'")
    tag, value = gone.select("k", "tag", F.lit(True).alias("by_tag")).distinct(), gone.select("k", "e", F.lit(True).alias("by_value")).distinct()
    added = log.where("op = 'set'").join(tag, ["k", "tag"], "left").join(value, ["k", "e"], "left")
    return added.groupBy("k").agg(F.count_distinct(F.when(F.col("by_tag").isNull(), F.col("e"))).alias("or_set"), F.count_distinct(F.when(F.col("by_value").isNull(), F.col("e"))).alias("two_phase"))


@query("r5_clock_order", "SELECT k, CASE WHEN a0=b0 AND a1=b1 AND a2=b2 THEN 'Equal' WHEN a0<=b0 AND a1<=b1 AND a2<=b2 THEN 'Before' WHEN a0>=b0 AND a1>=b1 AND a2>=b2 THEN 'After' ELSE 'Concurrent' END AS rel FROM (SELECT k, count(*) FILTER (WHERE replica=0 AND seq%2=0) AS a0, count(*) FILTER (WHERE replica=1 AND seq%2=0) AS a1, count(*) FILTER (WHERE replica=2 AND seq%2=0) AS a2, count(*) FILTER (WHERE replica=0 AND seq%2=1) AS b0, count(*) FILTER (WHERE replica=1 AND seq%2=1) AS b1, count(*) FILTER (WHERE replica=2 AND seq%2=1) AS b2 FROM fx_replica_log GROUP BY 1)")
def r5(s, d):
    c = load(s, d, "fx_replica_log").groupBy("k", "replica").agg(F.count_if(F.col("seq") % 2 == 0).alias("a"), F.count_if(F.col("seq") % 2 == 1).alias("b"))
    clock = lambda x: F.map_from_entries(F.collect_list(F.struct("replica", x)))
    return c.groupBy("k").agg(clock("a").alias("a"), clock("b").alias("b")).select("k", G.clock_order(F.col("a"), F.col("b")).alias("rel"))


@query("r6_three_way_merge", "SELECT o_orderkey AS k, CASE WHEN l=b THEN r WHEN r=b OR l=r THEN l END AS merged, l<>b AND r<>b AND l<>r AS conflict FROM (SELECT o_orderkey, o_totalprice AS b, CASE WHEN o_orderkey%5=0 THEN o_totalprice+1 ELSE o_totalprice END AS l, CASE WHEN o_orderkey%7=0 THEN o_totalprice+2 ELSE o_totalprice END AS r FROM orders)")
def r6_merge(s, d):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    o = load(s, d, "orders").select(k.alias("k"), p.alias("b"), F.when(k % 5 == 0, p + 1).otherwise(p).alias("l"), F.when(k % 7 == 0, p + 2).otherwise(p).alias("r"))
    b, a, c = F.col("b"), F.col("l"), F.col("r")
    return o.select("k", F.when(a == b, c).when((c == b) | (a == c), a).alias("merged"), ((a != b) & (c != b) & (a != c)).alias("conflict"))


@query("r8_restore", "SELECT o_orderkey AS k, CASE WHEN o_orderkey%10=2 THEN o_totalprice+1.0 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey%10<>3")
def r8(s, d):
    a, b = load(s, d, "fx_snap_a").select("k", "v"), load(s, d, "fx_snap_b").select("k", "v")
    kind = R.diff(a, b, "k")
    changes = kind.join(b, "k", "left").select("k", (F.col("k") + 1).alias("seq"), F.when(F.col("change") == "Deleted", "delete").otherwise("set").alias("op"), "v")
    return G.restored(a, changes, "k", "seq", 2**62)


@query("r9_recovery_point", "SELECT event_id, (SELECT max(o.ts) FROM events o WHERE o.user_id=e.user_id AND o.event_type='signup' AND o.ts <= e.ts) AS point FROM events e WHERE event_type='error'")
def r9(s, d):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    point = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w)
    return load(s, d, "events").select("event_id", "event_type", point.alias("point")).where("event_type = 'error'").select("event_id", "point")


@query("r10_gfs_tiers", "SELECT tier, event_id FROM (SELECT 'day' AS tier, event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts DESC) AS n FROM events UNION ALL SELECT 'week', event_id, row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts DESC) FROM events UNION ALL SELECT 'month', event_id, row_number() OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts DESC) FROM events UNION ALL SELECT 'year', event_id, row_number() OVER (PARTITION BY date_trunc('year', ts) ORDER BY ts DESC) FROM events) WHERE n = 1")
def r10(s, d):
    e = load(s, d, "events")
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.date_trunc(t, "ts").alias("at")) for t in ("day", "week", "month", "year")])).alias("t")
    return e.select("event_id", "ts", tiers).groupBy("t.tier", "t.at").agg(F.max_by("event_id", "ts").alias("event_id")).select("tier", "event_id")


@query("r11_verify_copy", "SELECT s, n AS rows, true AS same FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)")
def r11(s, d):
    o = load(s, d, "orders").withColumnRenamed("o_orderstatus", "s")
    a, b = G.content_digest(o, ["s"]), G.content_digest(o.repartition(3).select(*reversed(o.columns)), ["s"]).select("s", F.col("n").alias("m"), F.col("digest").alias("other"))
    return a.join(b, "s", "full").select("s", F.col("n").alias("rows"), (F.col("n").eqNullSafe(F.col("m")) & F.col("digest").eqNullSafe(F.col("other"))).alias("same"))


@query("r12_rpo_report", "SELECT user_id, round(max(gap), 3) AS worst_s, round(avg(gap), 3) AS mean_s, max(gap) <= 5*86400 AS met FROM (SELECT user_id, (epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)))/1e6 AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1")
def r12(s, d):
    from ..operators.events import micros

    t = micros("ts")
    g = load(s, d, "events").select("user_id", ((t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts"))) / 1e6).alias("gap")).where("gap IS NOT NULL")
    return g.groupBy("user_id").agg(F.round(F.max("gap"), 3).alias("worst_s"), F.round(F.avg("gap"), 3).alias("mean_s"), (F.max("gap") <= 5 * 86400).alias("met"))


@query("r13_history_diff", "SELECT k, CASE WHEN a.k IS NULL THEN 'added' WHEN a.value<>b.value THEN 'changed' ELSE 'same' END AS change FROM (SELECT k, arg_max(value, seq) AS value FROM fx_replica_log WHERE seq <= 300 GROUP BY 1) a RIGHT JOIN (SELECT k, arg_max(value, seq) AS value FROM fx_replica_log WHERE seq <= 700 GROUP BY 1) b USING (k)")
def r13(s, d):
    from ..operators.events import as_of

    log = load(s, d, "fx_replica_log")
    a, b = (as_of(log, "k", "seq", n, ["value"]).select("k", F.col("value").alias(c)) for n, c in ((300, "a"), (700, "b")))
    return a.join(b, "k", "right").select("k", F.when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


@query("n8_salted_hash", "SELECT c_custkey, sha256(c_name || 'pepper') AS hashed FROM customer")
def n8(s, d):
    return load(s, d, "customer").select("c_custkey", F.sha2(F.concat("c_name", F.lit("pepper")), 256).alias("hashed"))
