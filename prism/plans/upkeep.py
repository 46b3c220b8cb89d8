"""Queries of screening, index upkeep, statistics and usage, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prism.functions import text as tx
from prism.functions.vectors import unit
from prism.operators import maintenance, screen
from prism.operators.incremental import normal_digest
from prism.session import table
from prism.streaming import usage


def a1_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = maintenance.current_files(table(spark, sf_dir, "files"))
    return f.groupBy(F.lower(F.trim("language")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("unnamed_calls").alias("unnamed_calls"))


def a2_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "card_vectors").select("channel", "model", "dims", "id").distinct()
    return v.groupBy("channel", "model").agg(F.count("*").alias("cards"), F.max("dims").alias("dims"), F.countDistinct(F.substring_index("id", "#", 1)).alias("sources"))


def a3_median_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cards").select("channel", "path", "id").distinct().groupBy("channel", "path").agg(F.count("*").alias("n"))
    return c.groupBy("channel").agg(F.median("n").alias("median"))


def i1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would do with each path: the state at the second succeeded run against that at the first."""
    runs = table(spark, sf_dir, "runs").where("status = 'succeeded'").select("run_id", "started_at").distinct()
    first = runs.withColumn("n", F.row_number().over(Window.orderBy("started_at"))).where("n <= 2").orderBy("n").collect()
    if len(first) < 2:
        return spark.createDataFrame([], "path string, action string")
    files = table(spark, sf_dir, "files").withColumn("content_hash", normal_digest("content_hash"))
    before, now = (maintenance.current_files(files, F.lit(r["started_at"])) for r in first)
    return maintenance.decide(now, before, first[0]["started_at"].timestamp() * 1000)


def s6_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "file_texts").where("content is not null").select("path", "content").distinct()
    return t.select("path", maintenance.minified(F.col("path"), F.col("content"), F.octet_length("content")).alias("minified"))


def a26_main_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang is not null and repo is not null").select("repo", F.lower(F.substring("lang", 1, 2)).alias("lang"), "doc_id")
    return maintenance.mode_first(d, "repo", "lang", "doc_id")


def a27_decayed_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = maintenance.decayed(table(spark, sf_dir, "events"), "event_type", "ts", F.lit("2024-02-01").cast("timestamp"))
    return d.select("event_type", F.round("score", 6).alias("score"), "runs")


def a29_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return maintenance.movements(e, "event_type", "day", "n").select("event_type", "day", "n", F.round("mean", 6).alias("mean"), "moved")


def a32_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(tx.bucket(F.col("value"), tx.DURATION_BUCKETS).alias("bucket"))
    return e.groupBy("bucket").agg(F.count("*").alias("n"))


def a20_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of symbols with a doc, by kind and over all."""
    s = table(spark, sf_dir, "symbols").select("id", F.lower(F.trim("kind")).alias("kind"), F.col("doc").isNotNull().cast("int").alias("has")).distinct()
    return s.rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg("has"), 6).alias("share"))


def g1_screen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "symbols").where("doc is not null").select("id", "path", F.col("doc").alias("text")).distinct()
    return screen.report(screen.screen(d))


def g2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return screen.screen(d, profile="strict").groupBy("verdict").agg(F.count("*").alias("n"))


def g4_first_of_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "symbols").where("doc is not null").select("id", "path", "doc").distinct()
    return screen.first_of_same(d, "doc").select("id")


def g5_flooding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for more symbols than ten times the usual."""
    d = table(spark, sf_dir, "symbols").where("base_name is not null").select(F.col("base_name").alias("path"), "id").distinct()
    return screen.flooding(d, "strict")


def w6_flood_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of a flooding name that are let through, those in excess, and where the finding stands."""
    d = table(spark, sf_dir, "symbols").where("base_name is not null").select(F.col("base_name").alias("path"), "id").distinct()
    return screen.flood_cut(d, ["id"], "strict").groupBy("path").agg(F.count("*").alias("cards"), F.count_if("excess").alias("excess"), F.max(F.when(F.col("finding"), F.col("id"))).alias("finding"))


def g6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return screen.outliers(e, ["label"], "strict").select("label", "id", F.round("z", 4).alias("z"))


def g6_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows near the centre of their batch under a threshold low enough to have some: outliers by the size of z."""
    v = table(spark, sf_dir, "card_vectors").where("vector is not null and size(vector) = dims and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))").select("id", "model", "vector", "dims").distinct()
    return screen.outliers(v, ["model", "dims"], threshold=1.0).select("model", "id", F.round("z", 4).alias("z"))


def w8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within two minutes of the one before, and days with events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("gap", F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag(F.col("ts").cast("timestamp")).over(w)))
    return e.groupBy("user_id").agg(F.count_if(F.col("gap") <= usage.REPEAT_MS).alias("repeats"), F.countDistinct(F.to_date("ts")).alias("days"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.windowed(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sessions(table(spark, sf_dir, "events"))


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join with a top-k report: revenue by nation and customer segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("r")).groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.sum("r").cast("decimal(24,4)").alias("revenue"))


QUERIES = {f.__name__: f for f in (a1_index_stats, a2_channel_stats, a3_median_cards, i1_decisions, s6_minified, a26_main_language, a27_decayed_use, a29_movements, a32_buckets, a20_rollup, g1_screen_report, g2_verdicts, g4_first_of_same, g5_flooding, w6_flood_cut, g6_outliers, g6_profiles, w8_repeats, windowed_events, session_events, top_customers)}

# RE2 has no look-around; \\b is ASCII there, which is what the look-around of the rules stands for
_RE2 = {r.id: r.pattern.replace(screen._B, r"\b").replace(screen._L, r"\b").replace(screen._R, r"\b").replace("$)", r"\z)") if "(?im)" not in r.pattern else r.pattern.replace(screen._B, r"\b").replace(screen._L, r"\b").replace(screen._R, r"\b") for r in screen.RULES}
_RE2["mixed-script-words"] = r"\p{Latin}[\p{L}\p{M}]*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{L}\p{M}]*\p{Latin}"


def _fires(rule: str, text: str) -> str:
    p = _RE2[rule].replace("'", "''")
    if rule == "imperative-density":
        n = f"len(regexp_extract_all({text}, '{p}'))"
        return f"({n} >= 3 and {n} * 40 >= len(regexp_extract_all({text}, '\\S+')))"
    return f"regexp_matches({text}, '{p}')"


def _verdict_sql(source: str, profile: str) -> str:
    """Text by text: what fires, the verdict, the clean text scanned again."""
    able = [r for r in screen.RULES if r.replacement is not None and getattr(r, profile) == screen.S]
    clean = "text"
    for r in able:
        p = _RE2[r.id].replace("'", "''")
        clean = f"case when {_fires(r.id, 'text')} then regexp_replace({clean}, '{p}', '{r.replacement}', 'g') else {clean} end"
    any_of = lambda action, text: " or ".join([_fires(r.id, text) for r in screen.RULES if getattr(r, profile) in action] or ["false"])
    return f"""with d as ({source}), c as (select *, {any_of((screen.Q,), "text")} as block, {any_of((screen.S,), "text")} as change, {clean} as cleaned from d)
select case when block then 'quarantine' when not change then 'pass' when {any_of((screen.S, screen.Q), "cleaned")} or trim(cleaned) = '' then 'quarantine' else 'sanitize' end as verdict, count(*) as n from c group by 1"""


_MIN = """with t as (select distinct path, content from file_texts where content is not null), s as (select path, content, strlen(content) as size, replace(lower(path), chr(92), '/') as p, content[1:50000] as x from t),
l as (select *, list_transform(string_split(replace(x, chr(13), ''), chr(10)), lambda v: length(v)) as ls, length(x) / len(string_split(replace(x, chr(13), ''), chr(10))) as average,
 regexp_matches(p, '/public/js/|/public/dist/|/public/assets/|/dist/js/|/dist/assets/|/build/static/|/assets/js/') or contains(x, 'webpackChunk') or contains(x, '__webpack_require__') or contains(x, '/*! For license information please see') or contains(x, 'parcelRequire') or contains(x, 'System.register(') as asset from s)
select path, case when regexp_matches(p, '\\.min\\.(js|mjs|cjs|css)$') and size > 512 then true when length(content) < 1536 then false when list_max(ls) > 1000 and asset then true when list_max(ls) > 10000 then true when average > 500 and len(ls) <= 15 then true when list_max(ls) > 2000 and average > 200 then true else false end as minified from l"""
_Z = """u as (select {0}, id, list_transform(vector, lambda x: x::double / sqrt(list_dot_product(vector::double[], vector::double[]))) as u from v where list_dot_product(vector::double[], vector::double[]) > 0),
p as (select {0}, i, sum(x) as x from (select {0}, unnest(u) as x, generate_subscripts(u, 1) as i from u) group by all), c as (select {0}, list(x order by i) as c from p group by all),
s as (select {0}, id, list_dot_product(u, c) / sqrt(list_dot_product(c, c)) as s from u join c using ({0})), m as (select {0}, median(s) as m, count(*) as n from s group by all having count(*) >= 8),
d as (select {0}, mad, m from (select {0}, any_value(m) as m, median(abs(s - m)) as mad from s join m using ({0}) group by all) where mad > 0)"""

_CUR = "(select * from (select *, row_number() over (partition by path order by seen_at desc, loaded_at desc) as rn from files where content_hash is not null {0}) where rn = 1)"
_DIG = "regexp_replace(lower(trim({0}.content_hash)), '^[a-z][a-z0-9_-]*[:=]', '')"
ORACLE = {
    "a1_index_stats": f"select lower(trim(language)) as language, count(*) as files, sum(size)::long as bytes, sum(unnamed_calls)::long as unnamed_calls from {_CUR.format('')} group by 1",
    "a2_channel_stats": "select channel, model, count(*) as cards, max(dims) as dims, count(distinct string_split(id, '#')[1]) as sources from (select distinct channel, model, dims, id from card_vectors) group by 1, 2",
    "a3_median_cards": "select channel, median(n) as median from (select channel, path, count(*) as n from (select distinct channel, path, id from cards) group by 1, 2) group by 1",
    "i1_decisions": f"""with r as (select started_at, row_number() over (order by started_at) as n from (select distinct run_id, started_at from runs where status = 'succeeded')),
b as {_CUR.format("and loaded_at <= (select started_at from r where n = 1)")}, a as {_CUR.format("and loaded_at <= (select started_at from r where n = 2)")}
select coalesce(a.path, b.path) as path, case when a.path is null then 'remove' when b.path is null then 'extract' when a.size = b.size and a.mtime_ms = b.mtime_ms and a.mtime_ms < (select epoch_us(started_at) / 1000.0 from r where n = 1) - 2000 then 'unchanged'
 when {_DIG.format("a")} = {_DIG.format("b")} then 'touch' else 'extract' end as action from a full join b on a.path = b.path""",
    "a26_main_language": "select repo, lang, n from (select repo, lang, count(*) as n, row_number() over (partition by repo order by count(*) desc, min(doc_id)) as r from (select repo, lower(lang[1:2]) as lang, doc_id from documents where lang is not null and repo is not null) group by 1, 2) where r = 1",
    "a27_decayed_use": "select event_type, round(sum(pow(2.0, -(epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / (86400000000.0 * 14))), 6) as score, count(*) as runs from events group by 1",
    "a29_movements": """with e as (select event_type, ts::date as day, count(*)::double as n from events group by 1, 2), m as (select *, avg(n) over (partition by event_type order by day rows between 3 preceding and 1 preceding) as mean from e)
select event_type, day, n, round(mean, 6) as mean, case when mean is null then 'new' when n - mean > abs(mean) * 0.25 then 'up' when n - mean < -abs(mean) * 0.25 then 'down' else 'same' end as moved from m""",
    "a32_buckets": "select case when value is null then null when value < 10 then '<10' when value < 50 then '10-50' when value < 200 then '50-200' when value < 1000 then '200-1000' when value < 5000 then '1000-5000' when value < 30000 then '5000-30000' when value < 120000 then '30000-120000' else '120000+' end as bucket, count(*) as n from events group by 1",
    "a20_rollup": "select kind, count(*) as n, round(avg(has), 6) as share from (select distinct id, lower(trim(kind)) as kind, (doc is not null)::int as has from symbols) group by rollup(kind)",
    "s6_minified": _MIN,
    "g1_screen_report": " union all ".join(f"select '{r.id}' as rule, count(*) filter (where '{r.standard}' = 'flag') as flagged, count(*) filter (where '{r.standard}' = 'sanitize') as sanitised, count(*) filter (where '{r.standard}' = 'quarantine') as quarantined from (select distinct id, path, doc as text from symbols where doc is not null) where {_fires(r.id, 'text')} having count(*) > 0" for r in screen.RULES),
    "g2_verdicts": _verdict_sql("select doc_id, coalesce(text, '') as text from documents", "strict"),
    "g6_outliers": "with v as (select label, vec_id as id, embedding as vector from embeddings), " + _Z.format("label") + " select label, id, round(0.6745 * (s - m) / mad, 4) as z from s join d using (label) where 0.6745 * (s - m) / mad > 3.0",
    "g6_profiles": "with v as (select distinct id, model, vector, dims from card_vectors where vector is not null and len(vector) = dims and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0), " + _Z.format("model, dims") + " select model, id, round(0.6745 * (s - m) / mad, 4) as z from s join d using (model, dims) where 0.6745 * (s - m) / mad > 1.0",
    "g4_first_of_same": "select id from (select id, row_number() over (partition by path, lower(regexp_replace(trim(doc), '\\s+', ' ', 'g')) order by id) as n from (select distinct id, path, doc from symbols where doc is not null)) where n = 1",
    "g5_flooding": "with p as (select base_name as path, count(distinct id) as cards from symbols where base_name is not null and id is not null group by 1) select path, cards, (10 * greatest(1.0, (select median(cards) from p)))::double as allowed from p where cards > 10 * greatest(1.0, (select median(cards) from p))",
    "w6_flood_cut": "with c as (select path, id, row_number() over (partition by path order by id) as n from (select distinct base_name as path, id from symbols where base_name is not null)), a as (select 10 * greatest(1.0, median(k)) as allowed from (select count(*) as k from c group by path)) select path, count(*) as cards, count(*) filter (where n > allowed) as excess, max(case when n = floor(allowed) + 1 then id end) as finding from c, a group by 1",
    "w8_repeats": "select user_id, count(*) filter (where gap <= 120000) as repeats, count(distinct ts::date) as days from (select user_id, ts, epoch_ms(ts) - epoch_ms(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events) group by 1",
    "windowed_events": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "session_events": """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as b from events),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g) select min(ts) as start, max(ts) + interval 30 minute as stop, user_id, count(*) as n from s group by user_id, k""",
    "top_customers": "select n_name, c_mktsegment, sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4)))::decimal(24,4) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
}
