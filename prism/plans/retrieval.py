"""Queries of retrieval and ranking over embeddings, cards and documents, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prism.functions import text as tx
from prism.functions.vectors import unit
from prism.operators import ranking
from prism.session import table

ASKED = "sort the path of every stale graph in order"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("vector"), "label").where("vector is not null")


def v1_cosine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated queries, every id divisible by 100, against all vectors: the 10 nearest."""
    v = _vectors(spark, sf_dir)
    top = ranking.search_many(v, v.where(F.col("id") % 100 == 0), 10)
    return top.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def v1_collapsed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vector of each label, then the best labels."""
    v = _vectors(spark, sf_dir)
    q = [0.1] * 64
    return ranking.cosine_search(v, q, 5, group="label").select("id", F.round("score", 6).alias("score"))


def a7_hub_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hub_means(_vectors(spark, sf_dir)).select("id", F.round("mean", 6).alias("mean"))


def v3_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine less the hub penalty, each step in float32, for the stated queries."""
    v = _vectors(spark, sf_dir)
    top = ranking.search_many(v, v.where(F.col("id") % 100 == 0), 20)
    j = top.join(ranking.hub_means(v), "id")
    s = (F.col("score").cast("float") - (F.lit(ranking.HUB_WEIGHT) * F.col("mean")).cast("float")).cast("float")
    return j.select("query_id", "id", F.round(s.cast("double"), 4).alias("score"))


def a8_bm25_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = ranking.bm25_stats(table(spark, sf_dir, "documents"))
    return df


def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.bm25(table(spark, sf_dir, "documents"), ASKED, id_col="doc_id")
    return r.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def a9_fused_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lanes over repositories of documents: by recency, by length and by count, fused by weight."""
    d = table(spark, sf_dir, "documents").where("repo is not null").groupBy("repo").agg(F.max("created_at").alias("t"), F.sum("n_chars").alias("c"), F.count("*").alias("n"))
    lane = lambda name, i, w, order: d.select(F.lit(name).alias("lane"), F.lit(i).alias("lane_pos"), F.lit(w).alias("weight"), F.row_number().over(Window.orderBy(F.desc(order), "repo")).alias("pos"), F.col("repo").alias("key"), F.col("n").cast("double").alias("score"))
    lanes = lane("recent", 0, 1.0, "t").unionByName(lane("long", 1, 0.5, "c")).unionByName(lane("many", 2, 2.0, "n"))
    return ranking.fuse(lanes).select("key", F.round("score", 9).alias("score"), "best_score", F.array_join("found_by", ",").alias("found_by"))


def overlap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of the query with names of symbols, over distinct query words and over distinct name words."""
    s = table(spark, sf_dir, "symbols").select("id", "name").distinct()
    q = F.array_distinct(tx.words(F.lit(ASKED)))
    n = F.array_distinct(tx.words(F.col("name")))
    hit = F.size(F.array_intersect(q, n))
    return s.select("id", F.round(hit / F.greatest(F.lit(1), F.size(q)), 6).alias("name_hit"), F.round(hit / F.greatest(F.lit(1), F.size(n)), 6).alias("name_cover"))


TREES = [
    {"left": [1, -1, -1], "right": [2, -1, -1], "feature": [0, 0, 0], "value": [0.2, -0.25, 0.5], "default_left": [1, 0, 0]},
    {"left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1], "feature": [1, 0, 0, 0, 0], "value": [0.4, 0.1, 0.75, -0.125, 0.0625], "default_left": [0, 1, 0, 0, 0]},
]


def v5_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = overlap_features(spark, sf_dir).withColumn("name_cover", F.when(F.col("name_cover") > 0, F.col("name_cover")))
    return ranking.score_trees(f, ["name_hit", "name_cover"], TREES, 0.5).select("id", F.col("tree_score").cast("double").alias("tree_score"))


def e3_recall_and_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well nearest vectors share the label of the stated queries."""
    v = _vectors(spark, sf_dir)
    top = ranking.search_many(v, v.where(F.col("id") % 100 == 0), 11).where("query_id <> id")
    results = top.join(v.select("id", "label"), "id").select("query_id", F.col("rank").alias("pos"), F.col("label").cast("string").alias("file"))
    relevant = v.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("label").cast("string").alias("file"))
    return ranking.recall_and_mrr(ranking.first_relevant(results, relevant)).select("queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "misses")


def a22_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(*[ranking.nearest_rank(p, "n_chars").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))])
    return d


def card_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card of each path and group: the longest, earlier id on ties."""
    c = table(spark, sf_dir, "cards").where("card is not null").select("path", "group_key", "id", F.length("card").alias("n")).distinct()
    g = c.groupBy("path", "group_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("m"))
    return g.select("path", "group_key", F.col("m.id").alias("id"), (-F.col("m.n")).alias("n"))


QUERIES = {f.__name__: f for f in (v1_cosine_search, v1_collapsed_search, a7_hub_means, v3_first_stage, a8_bm25_words, bm25_documents, a9_fused_lanes, overlap_features, v5_tree_scores, e3_recall_and_mrr, a22_nearest_rank, card_collapse)}

_V = "v as (select vec_id as id, label, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings)"
_TOP = f"with {_V}, s as (select a.id as query_id, b.id, a.label as ql, b.label, list_dot_product(a.u, b.u) as score from v a, v b where a.id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)"
_HUB = "h as (select id, coalesce(avg(s) filter (where n > 1), 0) as mean from (select a.id, list_dot_product(a.u, b.u) as s, row_number() over (partition by a.id order by list_dot_product(a.u, b.u) desc) as n from v a, v b) where n <= 11 group by 1)"
_STOP = "', '".join(tx.STOP)
_W = lambda c: f"list_filter(regexp_extract_all(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda w: w not in ('{_STOP}'))"
_F = f"select id, round(h / greatest(1, q), 6) as name_hit, round(h / greatest(1, n), 6) as name_cover from (select id, len(list_intersect(list_distinct({_W('name')}), list_distinct({_W(repr(ASKED))}))) as h, len(list_distinct({_W(repr(ASKED))})) as q, len(list_distinct({_W('name')})) as n from (select distinct id, name from symbols))"

ORACLE = {
    "v1_cosine_search": _TOP + " select query_id, id, round(score, 6) as score, rank::int as rank from r where rank <= 10",
    "v1_collapsed_search": f"with {_V}, s as (select id, label, list_sum(list_transform(u, lambda x: x * 0.1)) as score from v) select id, round(score, 6) as score from (select *, row_number() over (partition by label order by score desc, id) as n from s) where n = 1 order by score desc, id limit 5",
    "a7_hub_means": f"with {_V}, {_HUB} select id, round(mean, 6) as mean from h",
    "v3_first_stage": _TOP.replace("select a.id as query_id", "select a.id as query_id", 1) + f", {_HUB} select query_id, r.id, round((score::float - (0.3 * mean)::float)::float::double, 4) as score from r join h using (id) where rank <= 20",
    "a8_bm25_words": f"select word, count(*) as df from (select unnest(list_distinct({_W('text')})) as word from documents) group by 1",
    "bm25_documents": f"""with d as (select doc_id, {_W("text")} as w from documents), k as (select count(*) as docs, avg(len(w)) as al from d),
q as (select w as word, count(*) as times from (select unnest({_W(repr(ASKED))}) as w) group by 1), df as (select word, count(*) as df from (select unnest(list_distinct(w)) as word from d) group by 1),
tf as (select doc_id, len(w) as l, unnest(w) as word from d), t as (select doc_id, l, word, count(*) as f from tf where word in (select word from q) group by all)
select doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al))), 6) as score from t join q using (word) join df using (word), k group by 1""",
    "a9_fused_lanes": """with d as (select repo, max(created_at) as t, sum(n_chars) as c, count(*) as n from documents where repo is not null group by 1),
l as (select 0 as i, 'recent' as lane, 1.0::double as w, repo, row_number() over (order by t desc nulls last, repo) as r, n from d union all select 1, 'long', 0.5, repo, row_number() over (order by c desc, repo), n from d union all select 2, 'many', 2.0, repo, row_number() over (order by n desc, repo), n from d)
select repo as key, round(sum(w / (60 + r)), 9) as score, max(n)::double as best_score, string_agg(lane, ',' order by i) as found_by from l group by 1""",
    "overlap_features": _F,
    "v5_tree_scores": f"with f as ({_F}) select id, (0.5 + case when name_hit::float < 0.2::float then -0.25 else 0.5 end + case when name_cover > 0 and name_cover::float < 0.4::float then case when name_hit::float < 0.1::float then -0.125 else 0.0625 end else 0.75 end)::double as tree_score from f",
    "e3_recall_and_mrr": _TOP + """, x as (select *, row_number() over (partition by query_id order by rank) as p from r where rank <= 11 and query_id <> id),
f as (select query_id, label, ql, min(rank) as pos from x group by all), g as (select *, row_number() over (partition by query_id order by pos, label::varchar) as fr from f), h as (select query_id, min(fr) as fr from g where label = ql group by 1), q as (select distinct query_id from s)
select count(*) as queries, round(avg(case when fr <= 5 then 1.0 else 0.0 end), 6) as recall, round(avg(coalesce(1.0 / fr, 0)), 6) as mrr, count(*) filter (where fr is null) as misses from q left join h using (query_id)""",
    "a22_nearest_rank": "select source, list_sort(list(n_chars))[greatest(1, ceil(0.5 * count(*))::int)] as p50, list_sort(list(n_chars))[greatest(1, ceil(0.95 * count(*))::int)] as p95 from documents group by 1",
    "card_collapse": "select path, group_key, id, n::int as n from (select *, row_number() over (partition by path, group_key order by n desc, id) as r from (select distinct path, group_key, id, length(card) as n from cards where card is not null)) where r = 1",
}
