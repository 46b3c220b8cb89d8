"""Queries of the making of cards, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.functions import text as tx
from prism.operators import cards
from prism.plans.structural import _WORDS
from prism.session import table


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").where("path is not null and id is not null")
    return s.select("path", "seq", "id", "name", "base_name", F.lower(F.trim("kind")).alias("kind"), "parent_id", "signature", "doc", "start_line", "end_line").distinct()


def x21_normal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "symbols").where("doc is not null").select("doc").distinct()
    return d.select(F.md5("doc").alias("doc"), cards.normal_doc(F.col("doc")).alias("prose"))


def x22_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every evaluation item."""
    return table(spark, sf_dir, "eval_items").select("item_id", F.posexplode(tx.sentences(F.col("text"))).alias("n", "sentence"))


def x16_symbol_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, path line and signature of the card of every symbol (the prose of docs is x21)."""
    d = cards.symbol_drafts(_symbols(spark, sf_dir))
    return d.select("id", "key", "head", F.col("blocks")[0].alias("line"), "has_doc")


def x18_packed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbol cards in windows of forty tokens, completed: no text is lost, none is too long."""
    c = cards.completed(cards.packed(cards.symbol_drafts(_symbols(spark, sf_dir)), 40), "symbols")
    return c.select("card_id", "group_key", "part", "parts", "text")


def x17_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of all documents, read as Markdown."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return cards.section_drafts(d).select("path", "key", "head", F.size("blocks").alias("paragraphs"))


def x14_docblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.docblocks(table(spark, sf_dir, "file_texts")).select("path", "line", "tag", "value")


def x15_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of the source texts that answer GET."""
    return cards.find_routes(cards.routes(table(spark, sf_dir, "file_texts")), method="get")


def x28_embedded_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cards").where("card is not null and id is not null").select("id", F.get_json_object("card", "$.text").alias("text")).where("text is not null").distinct()
    return c.select("id", F.md5(cards.embedded_form(F.col("text"))).alias("text"))


QUERIES = {f.__name__: f for f in (x21_normal_docs, x22_sentences, x16_symbol_drafts, x18_packed_cards, x17_sections, x14_docblocks, x15_routes, x28_embedded_form)}

_RE = lambda p: p.replace("(?![A-Za-z0-9_])", "\\b").replace("(?<![A-Za-z0-9_])", "\\b").replace("'", "''")
_BARE = f"trim(regexp_replace(regexp_replace(trim(replace(s, chr(9), ' ')), '^(?:{_RE(cards._LEAD)}\\s*)+', ''), '(?:\\s*{_RE(cards._TRAIL)})+$', ''))"
_PROSE = f"trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(regexp_replace(doc, '{_RE(cards._FENCED)}', ' ', 'g'), '\\r?\\n'), lambda s: {_BARE}), ' '), '{_RE(cards._INLINE)}', '\\1', 'g'), '{_RE(cards._TAGS)}', ' ', 'g'), '\\s+', ' ', 'g'))"
_SY = "sy as (select distinct path, seq, id, name, base_name, lower(trim(kind)) as kind, parent_id, signature, doc, start_line, end_line from symbols where path is not null and id is not null)"
_PW = _WORDS.format("regexp_replace(path, '(?i)\\.[a-z0-9]+$', '')")

ORACLE = {
    "x21_normal_docs": f"select md5(doc) as doc, {_PROSE} as prose from (select distinct doc from symbols where doc is not null)",
    "x22_sentences": "with s as (select item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9\"''(`])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as p from eval_items where text is not null) select item_id, unnest(p) as sentence, generate_subscripts(p, 1) - 1 as n from s",
    "x16_symbol_drafts": f"""with recursive {_SY}, st as (select path, id, any_value(parent_id) as parent_id, any_value('/' || kind || '[@name=''' || base_name || ''']') as step from sy group by 1, 2),
w as (select path, id, parent_id as up, step as line from st union all select w.path, w.id, st.parent_id, st.step || w.line from w join st on st.path = w.path and st.id = w.up),
n as (select *, row_number() over (partition by path, name order by seq, id) as k from sy)
select id, case when k > 1 then name || '#' || k else name end as key, concat_ws(' — ', nullif(kind || ' ' || name, ''), nullif({_WORDS.format("base_name")}, ''), case when parent_id is not null then 'in ' || {_WORDS.format("regexp_extract(parent_id, '([^.#]+)$', 1)")} end, case when {_PW} <> '' then 'module ' || {_PW} end) as head, w.line, coalesce({_PROSE}, '') <> '' as has_doc
from n join (select path, id, line from w where up is null) w using (path, id)""",
    "x14_docblocks": f"""with l as (select path, unnest(s) as s, generate_subscripts(s, 1) as line from (select distinct path, string_split_regex(content, '\\r?\\n') as s from file_texts where content is not null and lower(regexp_extract(path, '\\.(\\w+)$', 1)) in ('{"', '".join(cards._TAGGED)}'))),
m as (select path, line, unnest(regexp_extract_all(s, '@([a-zA-Z0-9_-]+)(?:\\s+([^\\r\\n*]+))?')) as m from l)
select path, line, regexp_extract(m, '@([a-zA-Z0-9_-]+)', 1) as tag, coalesce(nullif(trim(regexp_extract(m, '@[a-zA-Z0-9_-]+(?:\\s+([^\\r\\n*]+))?', 1)), ''), 'true') as value from m""",
    "x28_embedded_form": "select distinct id, md5(array_to_string(list_filter(string_split(t, chr(10)), lambda s: s not like '/%'), chr(10))) as text from (select distinct id, try_cast(card as json)->>'$.text' as t from cards where card is not null and id is not null) where t is not null",
}
