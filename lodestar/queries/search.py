"""Registered queries: text search, facets and ranking, and page audits (families K and Q, the rest)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import load
from ..functions import geo
from ..operators import relational as R
from ..operators import search as X
from ..registry import query

c = F.col
r4, r6 = (lambda x: F.round(x, 4)), (lambda x: F.round(x, 6))
W = "list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
DOC = W.format(t="text")
HAV = "2*6371000*atan2(sqrt(a), sqrt(1-a))"
HAV_A = "pow(sin(radians(48.8-lat)/2),2)+cos(radians(lat))*cos(radians(48.8))*pow(sin(radians(2.3-lon)/2),2)"


def docs(s, d):
    return load(s, d, "documents")


def bm(terms, every=False, where="true"):
    n = len(terms)
    tf = ", ".join(f"len(list_filter(w, lambda x: x='{t}')) AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(n))
    score = "+".join(f"ln(1+(n-d{i}+0.5)/(d{i}+0.5))*t{i}*2.2/(t{i}+1.2*(0.25+0.75*dl/av))" for i in range(n))
    hit = (" AND " if every else " OR ").join(f"t{i} > 0" for i in range(n))
    return f"SELECT doc_id, {score} AS score FROM (SELECT doc_id, len(w) AS dl, {tf} FROM (SELECT doc_id, {DOC} AS w FROM documents) WHERE len(w) > 0) t, (SELECT count(*) AS n, avg(dl) AS av, {df} FROM (SELECT len(w) AS dl, {tf} FROM (SELECT {DOC} AS w FROM documents) WHERE len(w) > 0)) WHERE ({hit}) AND {where}"


@query("k1_stop_words", f"SELECT doc_id, len(list_filter({DOC}, lambda x: x NOT IN ('the','and','of','to','in','that','is','for','with','was')))::BIGINT AS n FROM documents")
def k1(s, d):
    return docs(s, d).select("doc_id", F.size(X.without(X.words("text"), X.STOP_WORDS["en"])).cast("long").alias("n"))


@query("k2_edge_grams", "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(2, greatest(2, least(5, length(p_name)))+1), lambda k: left(lower(p_name), k::INT))) AS gram FROM part) GROUP BY 1")
def k2(s, d):
    return load(s, d, "part").select(F.explode(X.edge_grams(F.lower("p_name"), 2, 5)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("k3_language")
def k3(s, d):
    return docs(s, d).select("doc_id", "lang", X.detected(X.words("text")).alias("guess"))


@query("k5_match_any", f"SELECT doc_id, round(score, 6) AS score FROM ({bm(['the', 'license', 'version'])})")
def k5(s, d):
    return X.bm25(docs(s, d), "doc_id", "text", ["the", "license", "version"]).select("doc_id", r6("score").alias("score"))


@query("k5_match_every", f"SELECT doc_id, round(score, 6) AS score FROM ({bm(['the', 'of'], True)})")
def k5_every(s, d):
    return X.bm25(docs(s, d), "doc_id", "text", ["the", "of"], every=True).select("doc_id", r6("score").alias("score"))


@query("k6_multi_match", "SELECT p_partkey, 3.0*(p_name ILIKE '%2%')::INT AS by_name, 1.0*(p_type ILIKE '%brass%')::INT AS by_type, greatest(3.0*(p_name ILIKE '%2%')::INT, 1.0*(p_type ILIKE '%brass%')::INT) AS best, 3.0*(p_name ILIKE '%2%')::INT+1.0*(p_type ILIKE '%brass%')::INT AS most FROM part WHERE p_name ILIKE '%2%' OR p_type ILIKE '%brass%'")
def k6(s, d):
    a, b = 3.0 * c("p_name").ilike("%2%").cast("int"), 1.0 * c("p_type").ilike("%brass%").cast("int")
    return load(s, d, "part").select("p_partkey", a.alias("by_name"), b.alias("by_type"), F.greatest(a, b).alias("best"), (a + b).alias("most")).where("best > 0")


def field_bm(field, terms, boost):
    """SQL for boosted scores of one field of part."""
    return f"SELECT p_partkey AS doc_id, {boost}*score AS score FROM ({bm(terms).replace('FROM documents', 'FROM (SELECT p_partkey AS doc_id, ' + field + ' AS text FROM part)')}) q(p_partkey, score)"


FIELDS = {"p_name": 3.0, "p_type": 1.0}
ASKED = ["brass", "steel", "1"]


@query("k6_scored_fields", "SELECT doc_id AS p_partkey, round(max(score)+0.3*(sum(score)-max(score)), 6) AS best, round(sum(score), 6) AS most FROM (" + " UNION ALL ".join(field_bm(f, ASKED, b) for f, b in FIELDS.items()) + ") GROUP BY 1")
def k6_scored(s, d):
    """Two fields, each scored on its own statistics and boosted."""
    p = load(s, d, "part")
    best = X.multi_match(p, "p_partkey", FIELDS, ASKED, "best", 0.3).withColumnRenamed("score", "best")
    return best.join(X.multi_match(p, "p_partkey", FIELDS, ASKED, "most"), "p_partkey").select("p_partkey", r6("best").alias("best"), r6("score").alias("most"))


@query("k6_cross_fields", "SELECT doc_id AS p_partkey, round(sum(top), 6) AS score FROM (SELECT doc_id, t, max(score) AS top FROM (" + " UNION ALL ".join(f"SELECT *, '{t}' AS t FROM ({field_bm(f, [t], b)})" for t in ASKED for f, b in FIELDS.items()) + ") GROUP BY 1, 2) GROUP BY 1")
def k6_cross(s, d):
    return X.multi_match(load(s, d, "part"), "p_partkey", FIELDS, ASKED, "cross").select("p_partkey", r6("score").alias("score"))


@query("k14_sounds_like")
def k14_sounds(s, d):
    """Documents with words that sound like three names."""
    return X.sounds_like(docs(s, d), "doc_id", "text", ["than", "wither", "fore"])


@query("k7_phrase", f"SELECT doc_id, n::BIGINT AS n FROM (SELECT doc_id, len(list_filter(range(0, len(w)-1), lambda k: w[k+1]='of' AND w[k+2]='the')) AS n FROM (SELECT doc_id, {DOC} AS w FROM documents)) WHERE n > 0")
def k7(s, d):
    return X.phrase(docs(s, d), "doc_id", "text", ["of", "the"]).select("doc_id", c("n").cast("long").alias("n"))


@query("k8_filters", "SELECT doc_id FROM documents WHERE lang IN ('en','fr') AND n_chars BETWEEN 200 AND 3000 AND source IS NOT NULL")
def k8(s, d):
    return docs(s, d).where(c("lang").isin("en", "fr") & c("n_chars").between(200, 3000) & c("source").isNotNull()).select("doc_id")


@query("k9_highlight", "SELECT item_id, regexp_replace(text, '\\b(the|and)\\b', '<em>\\1</em>', 'gi') AS marked FROM benchmark")
def k9(s, d):
    return load(s, d, "benchmark").select("item_id", F.regexp_replace("text", r"(?i)\b(the|and)\b", "<em>$1</em>").alias("marked"))


@query("k10_page_of_results", f"SELECT doc_id FROM ({bm(['the', 'of'])}) WHERE score >= 0.01 ORDER BY round(score, 9) DESC, doc_id LIMIT 10 OFFSET 10")
def k10(s, d):
    return X.bm25(docs(s, d), "doc_id", "text", ["the", "of"]).where("score >= 0.01").orderBy(F.desc(F.round("score", 9)), "doc_id").offset(10).limit(10).select("doc_id")


TERMS = f"SELECT term, count(*) AS n FROM (SELECT unnest({DOC}) AS term FROM documents) GROUP BY 1"


@query("k11_fuzzy", f"SELECT term, n, levenshtein(term, 'thing') AS distance FROM ({TERMS}) WHERE abs(length(term)-5) <= 1 AND levenshtein(term, 'thing') <= 1")
def k11(s, d):
    t = X.dictionary(docs(s, d), "text").where("abs(length(term) - 5) <= 1")
    return t.select("term", "n", F.levenshtein("term", F.lit("thing")).cast("long").alias("distance")).where("distance <= 1")


@query("k12_patterns", f"SELECT term, n, term LIKE 'th_n%' AS wild, regexp_matches(term, '^[a-e].*ing$') AS pattern, starts_with(term, 'con') AS prefix FROM ({TERMS}) WHERE term LIKE 'th_n%' OR regexp_matches(term, '^[a-e].*ing$') OR starts_with(term, 'con')")
def k12(s, d):
    t = c("term")
    return X.dictionary(docs(s, d), "text").select("term", "n", t.like("th_n%").alias("wild"), t.rlike("^[a-e].*ing$").alias("pattern"), t.startswith("con").alias("prefix")).where("wild OR pattern OR prefix")


@query("k13_similarity", "SELECT p_partkey, levenshtein(p_name, p_brand)::BIGINT AS distance, round(1-levenshtein(p_name, p_brand)/greatest(strlen(p_name), strlen(p_brand)), 6) AS similarity FROM part")
def k13(s, d):
    x = F.levenshtein("p_name", "p_brand")
    return load(s, d, "part").select("p_partkey", x.cast("long").alias("distance"), r6(1 - x / F.greatest(F.octet_length("p_name"), F.octet_length("p_brand"))).alias("similarity"))


@query("k14_phonetic")
def k14(s, d):
    t = X.dictionary(docs(s, d), "text").where(c("term").rlike("^[a-z]{3,}$"))
    return t.groupBy(F.soundex("term").alias("sound")).agg(F.count("*").alias("terms"), F.sum("n").alias("n"), F.min("term").alias("least"))


@query("k15_more_facets", "SELECT event_type AS value, date_trunc('week', ts) AS week, CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'middle' ELSE 'high' END AS range, count(*) AS n FROM events GROUP BY 1, 2, 3")
def k15(s, d):
    v = c("value")
    band = F.when(v < 25, "low").when(v < 75, "middle").otherwise("high")
    return load(s, d, "events").groupBy(c("event_type").alias("kind"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), band.alias("range")).agg(F.count("*").alias("n")).withColumnRenamed("kind", "value")


@query("k16_stats_facets", "SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, sum(n_chars)::BIGINT AS total, round(stddev_pop(n_chars), 4) AS sd, round(avg(n_chars)+2*stddev_pop(n_chars), 3) AS upper, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def k16(s, d):
    n, sd = c("n_chars"), F.stddev_pop("n_chars")
    return docs(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), r4(F.avg(n)).alias("mean"), F.sum(n).alias("total"), r4(sd).alias("sd"), F.round(F.avg(n) + 2 * sd, 3).alias("upper"), F.count_distinct("source").alias("sources"))


@query("k17_geo_facets", f"SELECT ring, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT value, CASE WHEN {HAV} < 1000000 THEN 'near' WHEN {HAV} < 5000000 THEN 'middle' ELSE 'far' END AS ring FROM (SELECT value, {HAV_A} AS a FROM fx_points)) GROUP BY 1")
def k17(s, d):
    m = geo.haversine(c("lon"), c("lat"), F.lit(2.3), F.lit(48.8))
    p = load(s, d, "fx_points").select("value", m.alias("m"))
    return p.groupBy(F.when(c("m") < 1e6, "near").when(c("m") < 5e6, "middle").otherwise("far").alias("ring")).agg(F.count("*").alias("n"), r4(F.avg("value")).alias("mean"))


@query("k18_geo_search", f"SELECT id, round({HAV}, 2) AS metres FROM (SELECT id, {HAV_A} AS a FROM fx_points WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN 0 AND 80) WHERE {HAV} <= 4000000 ORDER BY {HAV}, id LIMIT 50")
def k18(s, d):
    p = load(s, d, "fx_points").where("lon BETWEEN -60 AND 60 AND lat BETWEEN 0 AND 80").select("id", geo.haversine(c("lon"), c("lat"), F.lit(2.3), F.lit(48.8)).alias("m"))
    return p.where("m <= 4000000").orderBy("m", "id").limit(50).select("id", F.round("m", 2).alias("metres"))


@query("k18_polygon_search", """WITH q(k, x1, y1) AS (VALUES (0, -100.0, -40.0), (1, 80.0, -20.0), (2, -20.0, 60.0)), e AS (SELECT x1, y1, lead(x1, 1, -100.0) OVER (ORDER BY k) AS x2, lead(y1, 1, -40.0) OVER (ORDER BY k) AS y2 FROM q)
  SELECT id, round(sqrt(pow(lon, 2)+pow(lat, 2)), 6) AS distance FROM fx_points, e GROUP BY id, lon, lat HAVING sum(((y1 > lat) <> (y2 > lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1)::INT)%2=1""")
def k18_polygon(s, d):
    """Points in a drawn triangle, with their distance from its centre of interest."""
    from ..functions import geometry as Y

    ring = Y.ring(*[(F.lit(x), F.lit(y)) for x, y in ((-100.0, -40.0), (80.0, -20.0), (-20.0, 60.0))])
    return load(s, d, "fx_points").where(Y.inside(c("lon"), c("lat"), ring)).select("id", r6(F.hypot("lon", "lat")).alias("distance"))


@query("k19_field_factor", "SELECT p_partkey, round(log10(p_retailprice+1), 6) AS log1p, round(ln(p_retailprice+2), 6) AS ln2p, round(sqrt(p_retailprice), 6) AS root, round(p_retailprice*p_retailprice, 2) AS square, round(1/p_retailprice, 9) AS reciprocal FROM part")
def k19(s, d):
    p = c("p_retailprice")
    return load(s, d, "part").select("p_partkey", r6(X.factor(p, "log1p")).alias("log1p"), r6(X.factor(p, "ln2p")).alias("ln2p"), r6(X.factor(p, "sqrt")).alias("root"), F.round(X.factor(p, "square"), 2).alias("square"), F.round(X.factor(p, "reciprocal"), 9).alias("reciprocal"))


@query("k20_decays", f"SELECT id, round(exp(pow(greatest(0, {HAV}-100000), 2)*ln(0.5)/pow(2000000, 2)), 5) AS by_place, round(exp(greatest(0, abs(value-3000)-50)*ln(0.5)/1000), 6) AS by_value, round(greatest(0, 1-abs(value-3000)*0.5/2000), 8) AS straight FROM (SELECT id, value, {HAV_A} AS a FROM fx_points)")
def k20(s, d):
    p = load(s, d, "fx_points")
    m = geo.haversine(c("lon"), c("lat"), F.lit(2.3), F.lit(48.8))
    off = F.abs(c("value") - 3000)
    return p.select("id", F.round(X.decay(m, "gauss", 2e6, 1e5), 5).alias("by_place"), r6(X.decay(off, "exp", 1000.0, 50.0)).alias("by_value"), F.round(X.decay(off, "linear", 2000.0), 8).alias("straight"))


@query("k21_score_modes", "SELECT p_partkey, a*b AS multiply, a+b AS sum, (a+b)/2 AS avg, greatest(a, b) AS max, least(a, b) AS min FROM (SELECT p_partkey, p_size/10.0::DOUBLE AS a, CASE WHEN p_brand='Brand#11' THEN 2.0 ELSE 0.5 END::DOUBLE AS b FROM part)")
def k21(s, d):
    a, b = c("p_size") / 10, F.when(c("p_brand") == "Brand#11", 2.0).otherwise(0.5)
    return load(s, d, "part").select("p_partkey", (a * b).alias("multiply"), (a + b).alias("sum"), ((a + b) / 2).alias("avg"), F.greatest(a, b).alias("max"), F.least(a, b).alias("min"))


@query("k22_rescore", f"SELECT doc_id, row_number() OVER (ORDER BY round(0.7*score+0.3*ln(1+n_chars), 6) DESC, doc_id) AS rank FROM (SELECT * FROM ({bm(['the', 'of'])}) ORDER BY round(score, 9) DESC, doc_id LIMIT 40) JOIN documents USING (doc_id)")
def k22(s, d):
    top = X.bm25(docs(s, d), "doc_id", "text", ["the", "of"]).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(40)
    both = docs(s, d).select("doc_id", "n_chars").join(F.broadcast(top), "doc_id")
    return both.select("doc_id", F.row_number().over(Window.orderBy(F.desc(r6(0.7 * c("score") + 0.3 * F.log(1 + c("n_chars")))), "doc_id")).cast("long").alias("rank"))


@query("k23_suggest", f"SELECT asked, term, distance::BIGINT AS distance, n, rank FROM (SELECT asked, term, n, levenshtein(asked, term) AS distance, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(asked, term), n DESC, term) AS rank FROM ({TERMS}), (SELECT unnest(['thes', 'andd', 'vrsion']) AS asked) WHERE abs(length(term)-length(asked)) <= 2 AND levenshtein(asked, term) BETWEEN 1 AND CASE WHEN length(asked) <= 2 THEN 0 WHEN length(asked) <= 5 THEN 1 ELSE 2 END) WHERE rank <= 3")
def k23(s, d):
    return X.suggestions(X.dictionary(docs(s, d), "text"), ["thes", "andd", "vrsion"], 3).select("asked", "term", c("distance").cast("long").alias("distance"), "n", c("rank").cast("long").alias("rank"))


@query("k24_complete", f"SELECT prefix, term, n, rank FROM (SELECT left(term, 3) AS prefix, term, n, row_number() OVER (PARTITION BY left(term, 3) ORDER BY n DESC, term) AS rank FROM ({TERMS}) WHERE length(term) >= 3) WHERE rank <= 2")
def k24(s, d):
    t = X.dictionary(docs(s, d), "text").where("length(term) >= 3").select(F.left("term", F.lit(3)).alias("prefix"), "term", "n")
    return R.top_n(t, ["prefix"], [F.desc("n"), c("term")], 2).withColumn("rank", c("rank").cast("long"))


@query("k25_language_boost", f"SELECT doc_id, round(score*CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 1.5 ELSE 1 END, 6) AS score FROM ({bm(['the', 'der'])}) JOIN documents USING (doc_id)")
def k25(s, d):
    boost = F.when(c("lang") == "en", 2.0).when(c("lang") == "de", 1.5).otherwise(1.0)
    return X.bm25(docs(s, d), "doc_id", "text", ["the", "der"]).join(docs(s, d).select("doc_id", "lang"), "doc_id").select("doc_id", r6(c("score") * boost).alias("score"))


@query("k26_versioned_update", "SELECT k, count(*) FILTER (WHERE ok) AS applied, count(*) FILTER (WHERE NOT ok) AS stale FROM (SELECT user_id AS k, event_id%5 >= coalesce(max(event_id%5) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok FROM events) GROUP BY 1")
def k26(s, d):
    v = c("event_id") % 5
    before = F.coalesce(F.max(v).over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return load(s, d, "events").select(c("user_id").alias("k"), (v >= before).alias("ok")).groupBy("k").agg(F.count_if("ok").alias("applied"), F.count_if(~c("ok")).alias("stale"))


@query("k27_search_analytics", "SELECT user_id%30 AS query, count(*) AS n, round(avg(value), 6) AS mean_ms, count(*) FILTER (WHERE event_type='error') AS no_results, round(avg((event_type='click')::INT), 6) AS ctr FROM events GROUP BY 1")
def k27(s, d):
    kind = c("event_type")
    return load(s, d, "events").groupBy((c("user_id") % 30).alias("query")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_ms"), F.count_if(kind == "error").alias("no_results"), r6(F.avg((kind == "click").cast("int"))).alias("ctr"))


@query("k28_experiment", "SELECT variant, count(DISTINCT user_id) AS users, round(avg((event_type='purchase')::INT), 6) AS rate FROM (SELECT *, CASE WHEN ('0x'||left(md5('exp1:'||user_id), 4))::INT%100 < 50 THEN 'a' ELSE 'b' END AS variant FROM events) GROUP BY 1")
def k28(s, d):
    bucket = F.conv(F.left(F.md5(F.concat(F.lit("exp1:"), c("user_id").cast("string")).cast("binary")), F.lit(4)), 16, 10).cast("long") % 100
    return load(s, d, "events").withColumn("variant", F.when(bucket < 50, "a").otherwise("b")).groupBy("variant").agg(F.count_distinct("user_id").alias("users"), r6(F.avg((c("event_type") == "purchase").cast("int"))).alias("rate"))


def tags(s, d):
    return X.elements(load(s, d, "pages"))


#: Rewritings of a page's own links, bold starts and advertisements, as (pattern, replacement with \1): what they make of a page hangs on its words.
REWRITES = [
    (r'<li><a href="/(\w)', r'<li id="\1"><a href="/\1'), (r'<a href="/([^"]*[{kept}])">[^<]*</a>', r'<img src="/\1.png" alt="\1">'), (r'<a href="/([^"]*[{lost}])">[^<]*</a>', r'<img src="/\1.png">'),
    (r'<a href="/([^"]{{5,}})">[^<]*</a>', r'<a href="/\1" tabindex="5"></a>'), (r"<b>", r"<h3>"), (r'<div class="ad">([A-M])', r'<div class="ad" role="checkbox">\1'), (r'<div class="ad">([N-Z]\w+)', r'<div class="ad" role="\1">\1'),
]
KEPT, LOST = "a-m", "n-s"


def marked_up(s, d, kept=KEPT, lost=LOST):
    """Pages whose links became images (those on `lost` letters without a text), whose lists have ids and whose footers take colours from a digest of the title."""
    h = c("html")
    for pattern, put in REWRITES:
        h = F.regexp_replace(h, pattern.format(kept=kept, lost=lost), put.replace("\\1", "$1"))
    digest = F.md5(F.regexp_extract("html", "<title>([^<]*)</title>", 1).cast("binary"))
    footer = F.concat(F.lit('<footer style="color:#'), F.left(digest, F.lit(6)), F.lit(";background-color:#"), F.substring(digest, 7, 6), F.lit('">'))
    return load(s, d, "pages").select("page_id", F.replace(h, F.lit("<footer>"), footer).alias("html"))


def marked_sql(kept=KEPT, lost=LOST):
    h = "html"
    for pattern, put in REWRITES:
        h = f"regexp_replace({h}, '{pattern.format(kept=kept, lost=lost)}', '{put}', 'g')"
    digest = "md5(regexp_extract(html, '<title>([^<]*)</title>', 1))"
    return f"SELECT page_id, replace({h}, '<footer>', concat('<footer style=\"color:#', left({digest}, 6), ';background-color:#', substr({digest}, 7, 6), '\">')) AS html FROM pages"


def bad(s, d, kept=KEPT, lost=LOST):
    return X.elements(marked_up(s, d, kept, lost))


STRIPPED = r"regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>|<script\b.*?</script>|<style\b.*?</style>', '', 'gs')"


def tag_sql(kept=KEPT, lost=LOST):
    """SQL for the start tags (page_id, nth, raw) of the marked-up pages, and the text that follows each."""
    return f"SELECT page_id, unnest(range(len(l))) AS nth, unnest(l) AS raw FROM (SELECT page_id, regexp_extract_all({STRIPPED}, '<[a-zA-Z][^>]*>[^<]*') AS l FROM ({marked_sql(kept, lost)}))"


def value_sql(name):
    return f"regexp_extract(raw, '^<[^>]* {name}=\"([^\"]*)\"', 1)"


def has_sql(name):
    return f"regexp_matches(raw, '^<[^>]* {name}=')"


NO_ALT = "SELECT page_id, 'img' AS tag FROM ({tags}) WHERE starts_with(raw, '<img') AND " + value_sql("alt") + " = ''"
RULES = {
    "alt": (NO_ALT.format(tags=tag_sql()), "critical"),
    "label": (f"SELECT page_id, 'a' AS tag FROM ({tag_sql()}) WHERE regexp_matches(raw, '^<a [^>]*> *$')", "serious"),
    "id": (f"SELECT page_id, id, count(*)::BIGINT AS n FROM (SELECT page_id, {value_sql('id')} AS id FROM ({tag_sql()})) WHERE id <> '' GROUP BY 1, 2 HAVING count(*) > 1", "moderate"),
    "heading": (f"""SELECT page_id, unnest(list_filter([CASE WHEN lv-coalesce(prior, 0) > 1 THEN 'skipped' END, CASE WHEN bare THEN 'empty' END, CASE WHEN lv=1 AND ones > 1 THEN 'second_h1' END], lambda x: x IS NOT NULL)) AS issue, lv AS at
      FROM (SELECT page_id, lv, bare, lag(lv) OVER w AS prior, sum((lv=1)::INT) OVER w AS ones FROM (SELECT page_id, nth, substr(raw, 3, 1)::INT AS lv, trim(regexp_extract(raw, '>([^<]*)$', 1)) = '' AS bare FROM ({tag_sql()}) WHERE regexp_matches(raw, '^<h[1-6][ >]')) WINDOW w AS (PARTITION BY page_id ORDER BY nth))""", "moderate"),
    "tabindex": (f"SELECT page_id, 'tabindex' AS issue FROM ({tag_sql()}) WHERE {has_sql('tabindex')}", "minor"),
    "role": (f"SELECT page_id, role, CASE WHEN role='checkbox' THEN 'missing_attribute' ELSE 'unknown_role' END AS issue FROM (SELECT page_id, {value_sql('role')} AS role FROM ({tag_sql()}) WHERE {has_sql('role')})", "serious"),
}


@query("q1_elements", f"SELECT page_id, count(*) FILTER (WHERE NOT starts_with(t, '</')) AS opened, count(*) FILTER (WHERE starts_with(t, '</')) AS closed FROM (SELECT page_id, unnest(regexp_extract_all({STRIPPED}, '<[a-zA-Z/][^>]*>')) AS t FROM pages) GROUP BY 1")
def q1(s, d):
    return tags(s, d).groupBy("page_id").agg(F.count_if(c("kind") != "end").alias("opened"), F.count_if(c("kind") == "end").alias("closed"))


@query("q1_parents")
def q1_parents(s, d):
    e = tags(s, d)
    up = e.select("page_id", c("pos").alias("parent"), c("tag").alias("parent_tag"))
    return e.where("kind <> 'end'").join(up, ["page_id", "parent"]).groupBy("tag", "parent_tag").agg(F.count("*").alias("n"))


@query("q2_alternative_text", RULES["alt"][0])
def q2(s, d):
    return without_alt(bad(s, d))


def without_alt(e):
    need = c("tag").isin("img", "area", "object") | ((c("tag") == "input") & (X.attribute("type") == "image"))
    hidden = F.coalesce(X.attribute("aria-hidden") == "true", F.lit(False))
    return e.where(need & (c("kind") != "end") & ~hidden & (F.coalesce(X.attribute("alt"), F.lit("")) == "")).select("page_id", "tag")


@query("q3_labels", RULES["label"][0])
def q3(s, d):
    e = bad(s, d).where("kind <> 'end'")
    named = F.coalesce(X.attribute("aria-label"), X.attribute("title"), F.lit("")) != ""
    labels = e.where("tag = 'label'").select("page_id", X.attribute("for").alias("id")).distinct()
    fields = e.where(c("tag").isin("input", "select", "textarea") & ~named).select("page_id", "tag", X.attribute("id").alias("id")).join(labels, ["page_id", "id"], "left_anti").select("page_id", "tag")
    return fields.unionByName(e.where(c("tag").isin("a", "button") & ~named & (c("text") == "")).select("page_id", "tag"))


@query("q4_valid_language", "SELECT page_id, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS code, regexp_matches(regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1), '^[a-z]{2,3}(-[A-Za-z0-9]+)*$') AS valid, length(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)))::BIGINT AS title_length FROM pages")
def q4(s, d):
    e = tags(s, d).where("kind = 'start' AND tag IN ('html', 'title')")
    g = e.groupBy("page_id").agg(F.max(F.when(c("tag") == "html", F.coalesce(X.attribute("lang"), F.lit("")))).alias("code"), F.max(F.when(c("tag") == "title", F.length("text"))).cast("long").alias("title_length"))
    return g.select("page_id", "code", c("code").rlike("^[a-z]{2,3}(-[A-Za-z0-9]+)*$").alias("valid"), "title_length")


@query("q5_duplicate_ids", RULES["id"][0])
def q5(s, d):
    return bad(s, d).where("kind <> 'end'").select("page_id", X.attribute("id").alias("id")).where("id <> ''").groupBy("page_id", "id").agg(F.count("*").alias("n")).where("n > 1")


@query("q6_heading_order", RULES["heading"][0])
def q6(s, d):
    h = bad(s, d).where("kind = 'start'").where(c("tag").rlike("^h[1-6]$")).withColumn("at", F.substring("tag", 2, 1).cast("int"))
    w = Window.partitionBy("page_id").orderBy("pos")
    before, ones = F.coalesce(F.lag("at").over(w), F.lit(0)), F.sum((c("at") == 1).cast("int")).over(w)
    found = F.array_compact(F.array(F.when(c("at") - c("before") > 1, "skipped"), F.when(c("empty"), "empty"), F.when((c("at") == 1) & (c("ones") > 1), "second_h1")))
    return h.withColumn("before", before).withColumn("ones", ones).withColumn("empty", c("text") == "").select("page_id", F.explode(found).alias("issue"), "at")


@query("q7_lists", "SELECT page_id, n::BIGINT AS items, 0::BIGINT AS misplaced FROM (SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS n FROM pages) WHERE n > 0")
def q7(s, d):
    e = tags(s, d).where("kind <> 'end'")
    up = e.select("page_id", c("pos").alias("parent"), c("tag").alias("parent_tag"))
    items = e.where("tag = 'li'").join(up, ["page_id", "parent"], "left")
    return items.groupBy("page_id").agg(F.count("*").alias("items"), F.count_if(~F.coalesce(c("parent_tag").isin("ul", "ol", "menu"), F.lit(False))).alias("misplaced"))


@query("q8_presence", RULES["tabindex"][0])
def q8(s, d):
    e = bad(s, d).where("kind <> 'end'")
    rules = F.array_compact(F.array(F.when(X.attribute("tabindex").cast("int") > 0, "tabindex"), F.when((c("tag") == "meta") & (F.lower(X.attribute("http-equiv")) == "refresh"), "refresh"), F.when(c("tag").isin("blink", "marquee"), c("tag"))))
    return e.select("page_id", F.explode(rules).alias("issue"))


# Roles that pages may use, and attributes some of them need.
ROLES = "alert banner button checkbox complementary contentinfo dialog form grid heading img link list listbox listitem main menu menuitem navigation option presentation progressbar radio region search slider status switch tab table tabpanel textbox toolbar tooltip tree".split()
REQUIRED = {"checkbox": "aria-checked", "slider": "aria-valuenow", "heading": "aria-level", "option": "aria-selected", "switch": "aria-checked"}


@query("q9_roles", RULES["role"][0])
def q9(s, d):
    e = bad(s, d).where("kind <> 'end'").withColumn("role", X.attribute("role")).where("role IS NOT NULL")
    need = F.create_map(*[F.lit(x) for p in REQUIRED.items() for x in p])[c("role")]
    return e.select("page_id", "role", F.explode(F.array_compact(F.array(F.when(~c("role").isin(ROLES), "unknown_role"), F.when(need.isNotNull() & ~F.array_contains("attributes", F.coalesce(need, F.lit(""))), "missing_attribute")))).alias("issue"))


def lum(colour):
    """SQL for the relative luminance of six hexadecimal digits."""
    ch = [f"(CASE WHEN {x} <= 0.03928 THEN {x}/12.92 ELSE pow(({x}+0.055)/1.055, 2.4) END)" for x in (f"(('0x'||substr({colour}, {at}, 2))::INT/255.0)" for at in (1, 3, 5))]
    return f"(0.2126*{ch[0]}+0.7152*{ch[1]}+0.0722*{ch[2]})"


@query("q10_contrast", f"""SELECT page_id, round(ratio, 4) AS ratio, ratio >= 4.5 AS enough FROM (SELECT page_id, (greatest(la, lb)+0.05)/(least(la, lb)+0.05) AS ratio FROM (SELECT page_id, {lum('a')} AS la, {lum('b')} AS lb
  FROM (SELECT page_id, regexp_extract(html, 'style="color:#([0-9a-f]*);', 1) AS a, regexp_extract(html, 'background-color:#([0-9a-f]*)"', 1) AS b FROM ({marked_sql()}))))""")
def q10(s, d):
    style = X.attribute("style")
    e = bad(s, d).where("kind <> 'end'").select("page_id", F.regexp_extract(style, r"(?:^|;)\s*color:\s*(#[0-9a-fA-F]{6})", 1).alias("a"), F.regexp_extract(style, r"background-color:\s*(#[0-9a-fA-F]{6})", 1).alias("b")).where("a <> '' AND b <> ''")
    return e.select("page_id", X.contrast(c("a"), c("b")).alias("x")).select("page_id", r4("x").alias("ratio"), (c("x") >= 4.5).alias("enough"))


@query("q11_alt_quality", f"SELECT page_id, alt, length(alt) >= 3 AND length(alt) <= 125 AS fine FROM (SELECT page_id, {value_sql('alt')} AS alt FROM ({tag_sql()}) WHERE {has_sql('alt')})")
def q11(s, d):
    a = X.attribute("alt")
    e = bad(s, d).where("kind <> 'end' AND tag = 'img'").select("page_id", a.alias("alt")).where("alt IS NOT NULL")
    poor = (F.length("alt") > 125) | c("alt").rlike(r"(?i)\.(png|jpe?g|gif|svg)$") | c("alt").rlike(r"(?i)^(image|picture|photo|graphic) of") | (F.length("alt") < 3)
    return e.select("page_id", "alt", (~poor).alias("fine"))


@query("q12_landmarks", "SELECT page_id, len(regexp_extract_all(html, '<nav[ >]'))::BIGINT AS nav, len(regexp_extract_all(html, '<article[ >]'))::BIGINT AS article, len(regexp_extract_all(html, '<footer[ >]'))::BIGINT AS footer, false AS main FROM pages")
def q12(s, d):
    e = tags(s, d).where("kind = 'start'")
    n = lambda t: F.count_if(c("tag") == t)
    return e.groupBy("page_id").agg(n("nav").alias("nav"), n("article").alias("article"), n("footer").alias("footer"), (n("main") > 0).alias("main"))


# The weight of each severity in a page's score.
WEIGHTS = {"critical": 100, "serious": 75, "moderate": 50, "minor": 25}


def page_issues(s, d):
    q = {"alt": (q2, "critical"), "label": (q3, "serious"), "id": (q5, "moderate"), "heading": (q6, "moderate"), "tabindex": (q8, "minor"), "role": (q9, "serious")}
    out = None
    for name, (f, severity) in q.items():
        part = f(s, d).select("page_id", F.lit(name).alias("rule"), F.lit(severity).alias("severity"))
        out = part if out is None else out.unionByName(part)
    return out


ISSUES = " UNION ALL ".join(f"SELECT page_id, '{severity}' AS severity FROM ({sql})" for sql, severity in RULES.values())


@query("q13_score", f"SELECT page_id, sum(CASE severity WHEN 'critical' THEN 100 WHEN 'serious' THEN 75 WHEN 'moderate' THEN 50 ELSE 25 END)::BIGINT AS points, count(*) AS issues FROM ({ISSUES}) GROUP BY 1")
def q13(s, d):
    w = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])[c("severity")]
    return page_issues(s, d).groupBy("page_id").agg(F.sum(w).cast("long").alias("points"), F.count("*").alias("issues"))


@query("q13_page_score")
def q13_score(s, d):
    w = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])[c("severity")]
    n = bad(s, d).where("kind <> 'end'").groupBy("page_id").agg(F.count("*").alias("elements"))
    g = n.join(page_issues(s, d).groupBy("page_id").agg(F.sum(w).alias("points")), "page_id", "left")
    return g.select("page_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.coalesce("points", F.lit(0)) / c("elements"))).alias("score"))


@query("q14_breakdown", f"SELECT severity, count(*) AS n, count(DISTINCT page_id) AS pages FROM ({ISSUES}) GROUP BY 1")
def q14(s, d):
    return page_issues(s, d).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


LATER = ("d-p", "q-t")


@query("q15_between_scans", f"""WITH a AS (SELECT page_id, count(*) AS n FROM ({RULES['alt'][0]}) GROUP BY 1), b AS (SELECT page_id, count(*) AS n FROM ({NO_ALT.format(tags=tag_sql(*LATER))}) GROUP BY 1)
  SELECT page_id, CASE WHEN b.n IS NULL THEN 'resolved' WHEN a.n IS NULL THEN 'new' ELSE 'still' END AS change, coalesce(b.n, 0)-coalesce(a.n, 0) AS more FROM a FULL JOIN b USING (page_id)""")
def q15(s, d):
    """Pages that lost, gained or kept images without a text between two scans, the later one of pages marked up in another way."""
    scan = lambda name, *how: without_alt(bad(s, d, *how)).groupBy("page_id").agg(F.count("*").alias(name))
    both = scan("a").join(scan("b", *LATER), "page_id", "full")
    return both.select("page_id", F.when(c("b").isNull(), "resolved").when(c("a").isNull(), "new").otherwise("still").alias("change"), (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("more"))
