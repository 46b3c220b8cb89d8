"""Queries of the searches over cards and their vectors, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.functions.vectors import unit
from prism.operators import outline, paging, ranking, search
from prism.plans.retrieval import _F, _STOP, ASKED  # noqa: F401
from prism.session import cut, table

MODEL, TEXTS = "loam-code-96", "loam-text-128"


def vectors(spark: SparkSession, sf_dir: str, channel: str, model: str = MODEL) -> DataFrame:
    """(id, group_key, vector) of one channel and model, of unit length, each row once."""
    v = table(spark, sf_dir, "card_vectors").where((F.col("channel") == channel) & (F.col("model") == model) & (F.size("vector") == F.col("dims")))
    v = v.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return v.select("id", "group_key", "vector").distinct().select("id", "group_key", unit(F.col("vector")).alias("vector")).where("vector is not null and id is not null")


def asked_vector(spark: SparkSession, sf_dir: str, model: str = MODEL) -> list[float]:
    """The stated query: the vector of the first symbol card by id."""
    return list(vectors(spark, sf_dir, "symbols", model).orderBy("id").first()["vector"])


def hubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cut(vectors(spark, sf_dir, "symbols"))
    return v.join(ranking.hub_means(v), "id")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.read_cards(table(spark, sf_dir, "cards"))


def _stats(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BM25 over the first card of each symbol."""
    s = c.where("channel = 'symbols'").select(F.regexp_replace("group_key", r"#\d+$", "").alias("symbol"), "group_key", "id", search.without_path(F.col("text")).alias("text"))
    first = s.groupBy("symbol").agg(F.min_by("text", F.struct("group_key", "id")).alias("text"))
    return ranking.bm25_stats(first)


def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir)
    key = search.card_key(F.col("path"), F.col("symbol"), F.col("channel"), F.col("id"))
    return c.select("channel", "id", "path", "symbol", "kind", "has_doc", "start_line", "end_line", key.alias("key"), F.length(search.without_path(F.col("text"))).alias("n"))


def a5_symbol_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and best card of every symbol for the stated query."""
    s = search.symbol_scores(hubbed(spark, sf_dir), asked_vector(spark, sf_dir))
    return s.select("symbol", F.round(F.col("score").cast("double"), 4).alias("score"), "best_id", "first_id")


def v2_retrieve_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five of the stated query in the docs channel: one best card a group, screened after the cut."""
    w = paging.window(5, paging.encode_cursor(5))
    hits = search.retrieve(vectors(spark, sf_dir, "docs", TEXTS), asked_vector(spark, sf_dir, TEXTS), w.depth)
    texts = cards(spark, sf_dir).where("channel = 'docs'").select("id", "text").dropDuplicates(["id"])
    screened = cut(search.rescreen(cut(hits.join(texts, "id"))))
    p = paging.page(screened, [F.desc("score"), F.asc("id")], w)
    return p.rows.select("id", F.round("score", 6).alias("score"), F.lit(p.next_cursor is not None).alias("more"))


def v4_ranker_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the thirty candidates of the stated query."""
    top = search.symbol_scores(hubbed(spark, sf_dir), asked_vector(spark, sf_dir)).orderBy(*search.symbol_order()).limit(ranking.DEPTH)
    c = cut(cards(spark, sf_dir))
    r = search.ranker_features(ASKED, cut(top), c, _stats(c))
    return r.select("symbol", *[F.round(F.col(f).cast("double"), 4).alias(f) for f in search.FEATURES])


TREES = [
    {"left": [1, -1, -1], "right": [2, -1, -1], "feature": [0, 0, 0], "value": [0.1, -0.25, 0.5], "default_left": [1, 0, 0]},
    {"left": [1, 3, -1, -1, -1], "right": [2, 4, -1, -1, -1], "feature": [1, 2, 0, 0, 0], "value": [6.5, 0.5, 0.75, -0.125, 0.0625], "default_left": [0, 1, 0, 0, 0]},
]
TREE_FEATURES = ["card_hit", "depth", "kind_method"]


def v6_symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages: the first by vector less hub, its head reordered by the trees."""
    c = cut(cards(spark, sf_dir))
    s = search.symbol_search(ASKED, asked_vector(spark, sf_dir), hubbed(spark, sf_dir), c, _stats(c), TREE_FEATURES, TREES, 0.5, depth=20, limit=30)
    return s.select("symbol", "best_id", "first_rank", "shown_rank")


def a23_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.stages_summary(v6_symbol_search(spark, sf_dir)).withColumn("overlap_at_10", F.round("overlap_at_10", 6))


def _dense(spark: SparkSession, sf_dir: str, channel: str, depth: int, least: float | None = None) -> DataFrame:
    hits = search.retrieve(vectors(spark, sf_dir, channel, TEXTS), asked_vector(spark, sf_dir, TEXTS), depth, least=least)
    c = cards(spark, sf_dir).where(F.col("channel") == channel).dropDuplicates(["id"])
    return hits.join(c.drop("group_key"), "id")


def _lane(hits: DataFrame) -> DataFrame:
    keyed = hits.withColumn("key", search.card_key(F.col("path"), F.col("symbol"), F.col("channel"), F.col("id")))
    return search.lane_of(keyed, [F.desc("score"), F.asc("id")])


def _structural(spark: SparkSession, sf_dir: str, query: str, depth: int | None = None) -> DataFrame:
    n = outline.select(outline.nodes(table(spark, sf_dir, "symbols")), query)
    return n.orderBy("path", "pre").limit(depth) if depth else n


def v8_fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels and a structural lane, fused; the channels below a similarity are left out of it."""
    depth = paging.window(20).depth

    def structural() -> DataFrame:
        n = _structural(spark, sf_dir, "//method[@doc]", depth)
        keyed = n.select("path", "pre", search.node_key(F.col("path"), F.col("name"), F.col("tag"), F.col("start_line")).alias("key"), F.lit(None).cast("double").alias("score"))
        return search.lane_of(keyed, paging.by_place("path", "pre"))

    lanes = [("symbols", 1.0, lambda: _lane(_dense(spark, sf_dir, "symbols", depth, 0.2))), ("docs", 0.5, lambda: _lane(_dense(spark, sf_dir, "docs", depth, 0.2))), ("structural", 1.0, structural)]
    f = search.fused_search(lanes, ["symbols", "docs", "config", "structural"], weights={"docs": 0.25})
    return f.rows.select("key", F.round("score", 9).alias("score"), F.round("best_score", 6).alias("best_score"), F.array_join("found_by", ",").alias("found_by"))


BOTH = "walk the graph && //class/method[@doc]"


def v9_conjunction_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards near the stated query that a node of the path query matches, fused by channel."""
    _, path = search.split_conjunction(BOTH)
    nodes = cut(_structural(spark, sf_dir, path))
    fetch = max(paging.window(20).depth * search.CONJUNCTION_FACTOR, search.CONJUNCTION_LEAST)
    lane = lambda ch: lambda: _lane(search.matching_cards(_dense(spark, sf_dir, ch, fetch), nodes))
    f = search.fused_search([("symbols", 1.0, lane("symbols")), ("docs", 1.0, lane("docs"))], ["symbols", "docs"])
    return f.rows.select("key", F.round("score", 9).alias("score"), F.array_join("found_by", ",").alias("found_by"))


def v10_conjunction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the path query by the best of their cards."""
    _, path = search.split_conjunction(BOTH)
    fetch = max(paging.window(20).depth * search.CONJUNCTION_FACTOR, search.CONJUNCTION_LEAST)
    b = search.best_cards(_structural(spark, sf_dir, path), cut(_dense(spark, sf_dir, "symbols", fetch)))
    return b.select("path", "name", "start_line", F.round("score", 6).alias("score"))


def v11_structural_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty of a path query, by path and place."""
    return paging.page(_structural(spark, sf_dir, "//method[@doc]"), paging.by_place("path", "pre"), paging.window(20, paging.encode_cursor(40))).rows.select("path", "pre", "name")


def v13_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds: files by language, the largest packages, symbols by kind, cards by channel."""
    from prism.operators import maintenance

    f = maintenance.current_files(table(spark, sf_dir, "files"))
    s = table(spark, sf_dir, "symbols").where("id is not null").select("id", F.lower(F.trim("kind")).alias("kind")).distinct()
    c = table(spark, sf_dir, "cards").where("id is not null").select("channel", "id").distinct()
    part = lambda df, what, by: df.groupBy(by.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    packages = part(f.where("package_root is not null"), "package", F.col("package_root")).orderBy(F.desc("n"), "name").limit(12)
    return part(f, "language", F.lower(F.trim("language"))).unionByName(packages).unionByName(part(s, "kind", F.col("kind"))).unionByName(part(c, "channel", F.col("channel")))


def h21_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest symbol cards of each owner's repositories, fused over owners; one owner counts double."""
    from pyspark.sql import Window

    q = F.array(*[F.lit(x) for x in asked_vector(spark, sf_dir)])
    v = vectors(spark, sf_dir, "symbols").select(F.substring_index("id", "/", 1).alias("repo"), F.col("id").alias("key"), search.dot(F.col("vector"), q).alias("score"))
    pos = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "key"))
    pages = v.withColumn("pos", pos).where("pos <= 10")
    return search.federated(pages, {"hetare": 2.0}).select("key", F.round("score", 9).alias("score"), F.round("best_score", 6).alias("best_score"), F.array_join("found_by", ",").alias("found_by"))


QUERIES = {f.__name__: f for f in (v11_structural_page, v13_explain, h21_federated, card_fields, a5_symbol_scores, v2_retrieve_page, v4_ranker_features, v6_symbol_search, a23_stages, v8_fused_search, v9_conjunction_search, v10_conjunction_query)}

_OK = "vector is not null and len(vector) = dims and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 and id is not null"
_U = f"""vu as (select channel, id, group_key, list_transform(vector, lambda x: x::double / sqrt(list_dot_product(vector::double[], vector::double[]))) as u from (select distinct channel, id, group_key, vector from card_vectors where model = '{MODEL}' and {_OK})),
vq as (select u as q from vu where channel = 'symbols' order by id limit 1)"""
_C = """j as (select distinct * from (select channel, model, group_key, id, try_cast(card as json) as j from cards where card is not null and id is not null)),
c as (select distinct channel, model, group_key, id, j->>'$.source.path' as path, j->>'$.text' as text, j->>'$.attrs.symbol' as symbol, j->>'$.attrs.kind' as kind, coalesce(j->>'$.attrs.hasDoc' = 'true', false) as has_doc, (j->>'$.source.span.startLine')::int as start_line, (j->>'$.source.span.endLine')::int as end_line from j where j is not null and j->>'$.text' is not null and j->>'$.source.path' is not null)"""
_NP = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: x not like '/%'), chr(10))"
_KEY = "case when symbol <> '' then path || '#' || symbol else channel || ':' || id end"
_S = f"""{_U}, h as (select id, coalesce(avg(s) filter (where n > 1), 0) as mean from (select a.id, list_dot_product(a.u, b.u) as s, row_number() over (partition by a.id order by list_dot_product(a.u, b.u) desc) as n from vu a, vu b where a.channel = 'symbols' and b.channel = 'symbols') where n <= 11 group by 1),
r as (select id, group_key, list_dot_product(u, q)::float as cos, (0.3::float * mean::float)::float as pen from vu join h using (id), vq where channel = 'symbols'),
g as (select regexp_replace(group_key, '#\\d+$', '') as symbol, max((cos - pen)::float) as score, arg_min(id, (-((cos - pen)::float), id)) as best_id, arg_min(id, (group_key, coalesce(try_cast(regexp_extract(id, '~(\\d+)$', 1) as int), 0), id)) as first_id,
 arg_min(cos, (group_key, coalesce(try_cast(regexp_extract(id, '~(\\d+)$', 1) as int), 0), id)) as fc, arg_min(pen, (group_key, coalesce(try_cast(regexp_extract(id, '~(\\d+)$', 1) as int), 0), id)) as fp from r group by 1)"""
_W = lambda c: f"list_filter(regexp_extract_all(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda w: w not in ('{_STOP}'))"
_Q = _W(repr(ASKED))
_HIT = lambda c: f"len(list_intersect(list_distinct({_Q}), list_distinct({_W(c)})))"
_FEAT = f"""{_S}, {_C}, t as (select *, row_number() over (order by score desc, symbol) - 1 as rank from g qualify rank < {{0}}),
x as (select t.*, c.path, c.text, coalesce(c.symbol, '') as name, coalesce(c.kind, '') as kind, c.has_doc from t join (select distinct id, path, text, symbol, kind, has_doc from c) c on c.id = first_id),
bs as (select regexp_replace(group_key, '#\\d+$', '') as symbol, arg_min({_W(_NP)}, (group_key, id)) as w from c where channel = 'symbols' group by 1),
bw as (select count(*) as docs, avg(len(w)) as al from bs), bd as (select word, count(*) as df from (select unnest(list_distinct(w)) as word from bs) group by 1),
qw as (select word, count(*) as times from (select unnest({_Q}) as word) group by 1),
tf as (select symbol, l, word, count(*) as f from (select symbol, len({_W(_NP)}) as l, unnest({_W(_NP)}) as word from x) group by all),
bm as (select symbol, sum(times * ln(1 + (docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al))) as bm25_card from tf join qw using (word) left join bd using (word), bw group by 1),
f as (select x.symbol, rank, score as fused, ((max(score) over ()) - score)::float as fused_gap, fc as card_cos, fp as hub_pen, coalesce(bm25_card, 0) as bm25_card, {_HIT("name")} / greatest(1, len(list_distinct({_Q}))) as name_hit, {_HIT("name")} / greatest(1, len(list_distinct({_W("name")}))) as name_cover,
 {_HIT("path")} / greatest(1, len(list_distinct({_Q}))) as path_hit, {_HIT("text")} / greatest(1, len(list_distinct({_Q}))) as card_hit, case when len({_W("name")}) > 0 and contains({ASKED.lower()!r}, lower(name)) then 1 else 0 end as names_symbol, has_doc::int as has_doc, length(text) as card_len,
 len(string_split(path, '/')) - 1 as depth, count(*) over (partition by string_split(x.symbol, '#')[1]) - 1 as same_file, len({_Q}) as q_len, {", ".join(f"(kind = '{k}')::int as kind_{k}" for k in search.KINDS)} from x left join bm using (symbol))"""
_TREE = "0.5 + case when card_hit::float < 0.1::float then -0.25 else 0.5 end + case when depth < 6.5 then case when kind_method < 0.5 then -0.125 else 0.0625 end else 0.75 end"
_D = f"""{_U.replace(MODEL, TEXTS)}, {_C}, b as (select channel, group_key, id, s from (select channel, group_key, id, list_dot_product(u, q) as s, row_number() over (partition by channel, group_key order by list_dot_product(u, q) desc, id) as n from vu, vq) where n = 1),
d as (select *, row_number() over (partition by channel order by s desc, id) as pos from b),
k as (select d.channel, d.id, d.s, d.pos, c.path, c.symbol, c.start_line, c.end_line, {_KEY.replace("channel", "d.channel").replace("|| id", "|| d.id")} as key from d join (select distinct on (channel, id) * from c) c on c.channel = d.channel and c.id = d.id)"""
from prism.plans.structural import _NODES  # noqa: E402

_MEET = "k.path = m.path and ((m.name <> '' and k.symbol <> '' and (k.symbol = m.name or suffix(k.symbol, '.' || m.name) or suffix(m.name, '.' || k.symbol))) or (k.start_line >= m.start_line and k.end_line <= m.end_line))"
_METHODS = _NODES.rstrip() + ", m as (select * from nodes x where tag = 'method' and doc is not null and exists (select 1 from nodes c where c.path = x.path and c.pre = x.parent_pre and c.tag = 'class')), "

ORACLE = {
    "card_fields": f"with {_C} select channel, id, path, symbol, kind, has_doc, start_line, end_line, {_KEY} as key, length({_NP}) as n from c",
    "a5_symbol_scores": f"with {_S} select symbol, round(score::double, 4) as score, best_id, first_id from g",
    "v2_retrieve_page": f"with {_D}, x as (select id, s, (select count(*) from d where channel = 'docs') as n from d where channel = 'docs' and pos <= 11) select id, round(s, 6) as score, n > 10 as more from x order by s desc, id limit 5 offset 5",
    "v4_ranker_features": f"with {_FEAT.format(30)} select symbol, {', '.join(f'round({f}::double, 4) as {f}' for f in search.FEATURES)} from f",
    "v6_symbol_search": f"with {_FEAT.format(20)}, z as (select symbol, row_number() over (order by {_TREE} desc, rank) as n from f) select symbol, best_id, first_rank, coalesce(n, first_rank) as shown_rank from (select *, row_number() over (order by score desc, symbol) as first_rank from g) left join z using (symbol) where first_rank <= 30",
    "a23_stages": f"with {_FEAT.format(20)}, z as (select rank + 1 as fr, row_number() over (order by {_TREE} desc, rank) as n from f) select least(30, (select count(*) from g)) as candidates, (select fr from z where n = 1) <> 1 as top_changed, (select fr from z where n = 1) - 1 as shown_top_first_rank, round(count(*) filter (where fr <= 10 and n <= 10) / least(10, count(*)), 6) as overlap_at_10 from z",
    "v8_fused_search": _NODES.rstrip() + f""", {_D}, l as (select 0 as i, 'symbols' as lane, 1.0::double as w, pos, key, s from k where channel = 'symbols' and pos <= 21 and s >= 0.2 union all select 1, 'docs', 0.25, pos, key, s from k where channel = 'docs' and pos <= 21 and s >= 0.2
 union all select 2, 'structural', 1.0, row_number() over (order by path, pre), path || '#' || name, null from (select * from nodes where tag = 'method' and doc is not null order by path, pre limit 21)),
o as (select *, row_number() over (partition by lane order by pos) as r from (select i, lane, w, key, min(pos) as pos, arg_min(s, pos) as s from l group by 1, 2, 3, 4))
select key, round(sum(w / (60 + r)), 9) as score, round(max(s), 6) as best_score, string_agg(lane, ',' order by i) as found_by from o group by 1""",
    "v11_structural_page": _NODES + "select path, pre, name from nodes where tag = 'method' and doc is not null order by path, pre limit 20 offset 40",
    "v13_explain": """with f as (select * from (select *, row_number() over (partition by path order by seen_at desc, loaded_at desc) as rn from files where content_hash is not null and path is not null) where rn = 1)
select 'language' as what, lower(trim(language)) as name, count(*) as n from f group by 2 union all (select 'package', package_root, count(*) from f where package_root is not null group by 2 order by 3 desc, 2 limit 12) union all select 'kind', kind, count(*) from (select distinct id, lower(trim(kind)) as kind from symbols where id is not null) group by 2 union all select 'channel', channel, count(*) from (select distinct channel, id from cards where id is not null) group by 2""",
    "h21_federated": f"with {_U}, s as (select string_split(id, '/')[1] as repo, id, list_dot_product(u, q) as s from vu, vq where channel = 'symbols'), r as (select *, row_number() over (partition by repo order by s desc, id) as p from s) select repo || ':' || id as key, round(case when repo = 'hetare' then 2.0 else 1.0 end / (60 + p), 9) as score, round(s, 6) as best_score, repo as found_by from r where p <= 10",
    "v9_conjunction_search": _METHODS + f"""{_D}, l as (select channel, s, id, key from k where pos <= 500 and exists (select 1 from m where {_MEET})), o as (select channel, key, row_number() over (partition by channel order by s desc, id) as r from (select channel, key, max(s) as s, arg_min(id, (-s, id)) as id from l where channel in ('symbols', 'docs') group by 1, 2))
select key, round(sum(1 / (60 + r)), 9) as score, string_agg(channel, ',' order by channel desc) as found_by from o group by 1""",
    "v10_conjunction_query": _METHODS + f"{_D} select m.path, m.name, m.start_line, round(max(s), 6) as score from m join k on {_MEET} where channel = 'symbols' and pos <= 500 group by m.path, m.pre, m.name, m.start_line",
}
