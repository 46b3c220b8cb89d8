"""Queries of the training-data problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prism.llm import docpairs, leaks, neighbours, overlap, packing, reading, secrets, splits, syntax
from prism.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = syntax.check_files(table(spark, sf_dir, "file_texts"), table(spark, sf_dir, "files"))
    return checked.where("valid = false").select("path")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(syntax.check_files(table(spark, sf_dir, "file_texts"), table(spark, sf_dir, "files")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = docpairs.doc_pairs(table(spark, sf_dir, "symbols"))
    return pairs.where("doc_id = id").select("id").distinct()


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.doc_pairs(table(spark, sf_dir, "symbols"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = secrets.fields(table(spark, sf_dir, "cards"), table(spark, sf_dir, "symbols"))
    return secrets.scan(texts).select("field", "id").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = secrets.fields(table(spark, sf_dir, "cards"), table(spark, sf_dir, "symbols"))
    return secrets.scan(texts, redacted=True).select("field", "id", F.array_join("kinds", ", ").alias("kinds"), "redacted").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlap.cross_split_overlaps(table(spark, sf_dir, "pairs"))
    return o.select(F.least("train_id", "held_id").alias("pair_id_a"), F.greatest("train_id", "held_id").alias("pair_id_b")).distinct()


def p4_overlaps_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "pairs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.torn_sets(table(spark, sf_dir, "repos"), table(spark, sf_dir, "pairs"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "repos"), table(spark, sf_dir, "pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "card_vectors")).select("id_a", "id_b")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"))


#: Containers of p8_found, in tokens of the built-in tokenizer; of p8_containers, in those of a public one.
P8_CAPACITY = 1024
P8_TOKENIZER = "byte_bpe_50k.json"
#: The folder of tokenizers, where the session does not name one in spark.prism.tokenizers.
TOKENIZERS = "/opt/tokenizers"


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), P8_CAPACITY)
    return packed.where("pieces > 1 and piece = 0").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = spark.conf.get("spark.prism.tokenizers", TOKENIZERS)
    return packing.pack(table(spark, sf_dir, "documents"), 2048, f"{folder}/{P8_TOKENIZER}")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(packing.pack(table(spark, sf_dir, "documents"), P8_CAPACITY), P8_CAPACITY)


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs, and which share of them, each new split has."""
    s = p5_splits(spark, sf_dir).groupBy("new_split").agg(F.count("*").alias("n"))
    return s.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reading.reading_level(table(spark, sf_dir, "documents"))
    return r.where("words_per_sentence >= 22 and letters_per_word >= 6.0").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_pairs, p6_found, p6_redacted, p4_found, p4_overlaps_by_split, p5_found, p5_splits, p5_shares, p7_found, p8_found, p8_containers, p8_fill, p9_found, p10_found, p10_levels)}

_SPLIT = """case when regexp_replace(lower({0}), '[^a-z]', '', 'g') in ('train', 'training') then 'train'
 when regexp_replace(lower({0}), '[^a-z]', '', 'g') in ('val', 'valid', 'validation', 'dev') then 'val'
 when regexp_replace(lower({0}), '[^a-z]', '', 'g') in ('test', 'testing') then 'test' end"""

_OVERLAPS = f"""
with r as (select distinct pair_id, source, {_SPLIT.format("split")} as sp,
  list_distinct(regexp_extract_all(lower(concat_ws(' ', query, positive)), '[\\p{{L}}\\p{{N}}]+')) as w from pairs),
o as (select a.pair_id as train_id, b.pair_id as held_id, b.sp as held_split, b.source, len(list_intersect(a.w, b.w)) as c, len(a.w) + len(b.w) as s
  from r a join r b on a.sp = 'train' and b.sp in ('val', 'test') and len(a.w) > 0 and len(b.w) > 0 and a.pair_id <> b.pair_id
  and len(a.w) >= 0.8 * len(b.w) - 1e-9 and len(b.w) >= 0.8 * len(a.w) - 1e-9),
f as (select distinct train_id, held_id, held_split, source from o where c >= 0.8 * (s - c) - 1e-9)
"""

_CLEAN = "regexp_replace(regexp_replace(lower({0}), '[\\s\ufeff]+', '', 'g'), '[?#].*$', '')"
_HEAD = "'^(?:(?:git\\+)?[a-z]+://(?:[^/@]*@)?|[^/@:]+@)'"
_URL = "'^(?:www\\.)?([^/:]+?)\\.?(?::\\d+)?[/:]+([^/]+)/+([^/]+?)(?:\\.git)?(?:/.*)?$'"


def _place(column: str) -> str:
    """(host, owner, name) of a repository as text h/o/n, host blank for owner/name alone; null where it cannot be read."""
    c = _CLEAN.format(column)
    hosted = f"(regexp_matches({c}, {_HEAD}) or regexp_matches({c}, '^[^/:]+\\.[^/:]+/[^/]+/[^/]')) and regexp_matches(regexp_replace({c}, {_HEAD}, ''), {_URL})"
    full = f"regexp_extract(regexp_replace({c}, {_HEAD}, ''), {_URL}, ['h', 'o', 'n'])"
    bare = f"regexp_extract({c}, '^/*([^/:@]+)/+([^/]+?)(?:\\.git)?(?:/.*)?$', ['o', 'n'])"
    return f"case when {hosted} then {full}.h || '/' || {full}.o || '/' || {full}.n when {bare}.n <> '' then '/' || {bare}.o || '/' || {bare}.n end"


_TORN = f"""with recursive rp as (select distinct repo_id, {_place("url")} as p, {_place("mirror_of")} as m from repos where repo_id is not null),
k as (select repo_id, 'p/' || p as k from rp where p is not null union select repo_id, 'o/' || regexp_extract(p, '^(.*)/[^/]*$', 1) from rp where p is not null union select repo_id, 'p/' || m from rp where m is not null),
r as (select distinct repo_id as a, repo_id as b from rp union select r.a, y.repo_id from r join k x on x.repo_id = r.b join k y on y.k = x.k), c as (select a as repo_id, min(b) as first_repo_id from r group by 1),
w as (select p as n, first_repo_id from rp join c using (repo_id) where p is not null union all select regexp_replace(p, '^[^/]*', ''), first_repo_id from rp join c using (repo_id) where p is not null), kn as (select n, min(first_repo_id) as first_repo_id from w group by 1),
q as (select distinct pair_id, {_SPLIT.format("split")} as sp, {_place("repo")} as n from pairs where pair_id is not null), j as (select pair_id, sp, first_repo_id from q join kn using (n))
select distinct first_repo_id, pair_id from j where first_repo_id in (select first_repo_id from j where sp is not null group by 1 having count(distinct sp) > 1)"""

ORACLE = {
    "p5_found": _TORN,
    "p4_found": _OVERLAPS + "select distinct least(train_id, held_id) as pair_id_a, greatest(train_id, held_id) as pair_id_b from f",
    "p4_overlaps_by_split": _OVERLAPS + "select held_split, source, count(*) as overlaps, count(distinct held_id) as held_records, count(distinct train_id) as train_records from f group by 1, 2",
    "p7_found": """
with v as (select distinct id, model, dims, vector from card_vectors where vector is not null and len(vector) = dims
  and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
u as (select id, model, dims, list_transform(vector, lambda x: x::double) as w from v),
s as (select a.id as x, b.id as y, list_dot_product(a.w, b.w) / sqrt(list_dot_product(a.w, a.w) * list_dot_product(b.w, b.w)) as c
  from u a join u b on a.model = b.model and a.dims = b.dims and a.id <> b.id),
r as (select x, y, row_number() over (partition by x order by round(c, 9) desc, y) as n from s where c >= 0.85 - 1e-9)
select distinct least(x, y) as id_a, greatest(x, y) as id_b from r where n <= 5""",
    "p8_found": "select doc_id from documents where len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\pZ\\s]')) > 1024",
}
