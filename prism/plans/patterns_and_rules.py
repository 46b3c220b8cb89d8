"""Queries of patterns, policies, learned mappings and telemetry, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.operators import outline, patterns, policy, screen, trainer
from prism.plans.structural import _NODES
from prism.session import cut, table
from prism.streaming import telemetry

PATTERN = {"name": "documented", "target": {"kind": "method", "nameRegex": "^.*\\.(get|load|run)"}, "scope": {"within": "class", "directChild": True}, "filters": [{"attr": "doc", "op": "exists"}, {"attr": "signature", "op": "contains", "value": "$arg"}], "params": [{"name": "arg", "required": True}], "corpus": "broken"}
POLICY = {
    "rules": [{"id": "word-of-the-day", "category": "injection", "severity": "medium", "pattern": "\\bstale (parser|graph)s?\\b", "flags": "i", "replacement": "[gone]", "fixtures": {"attack": ["a Stale parser"], "benign": ["a parser"]}}],
    "actions": {"third-party": {"word-of-the-day": "sanitize"}, "untrusted": {"imperative-density": "off"}},
}


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.nodes(table(spark, sf_dir, "symbols"))


def pattern_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with a parameter, in the files of a corpus."""
    broken = table(spark, sf_dir, "files").where("has_syntax_errors = 1").select("path")
    p = patterns.compile_pattern(PATTERN)
    return patterns.run_pattern(_nodes(spark, sf_dir), p, {"broken": broken}, arg="(").select("path", "pre", "name")


def query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = patterns.Query.tag("class").where("exported", "=", "1").descendant("callable").where("name", "$=", "Graph").where("declaration")
    return outline.select(_nodes(spark, sf_dir), q.text).select("path", "pre", "name")


def g7_merged_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the evaluation items under a project's policy."""
    rules, _ = policy.merge([policy.check_policy(POLICY, "project")])
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return screen.screen(e, rules=rules).groupBy("verdict").agg(F.count("*").alias("n"))


def g9_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the project's own rule would find, nothing being written."""
    rules, _ = policy.merge([policy.check_policy(POLICY, "project")])
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return screen.preview(e, rules=tuple(r for r in rules if r.id == "word-of-the-day")).select("id", "verdict", F.array_join("rules", ",").alias("rules"), F.array_join("excerpts", ",").alias("excerpts"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as syntax: the kind of a symbol as its type; a child fills the field of its kind."""
    return _nodes(spark, sf_dir).select("path", "pre", "end_pre", "parent_pre", F.col("tag").alias("type"), F.when(F.col("parent_pre").isNotNull(), F.col("tag")).alias("field"))


def a25_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trainer.topology(_typed(spark, sf_dir))
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return t.select("type", "count", "files", told("parents").alias("parents"), told("ancestors").alias("ancestors"), told("fields").alias("fields"))


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("class", "class"), ("function", "function"), ("method", "method"), ("constant", "constant")], "type string, tag string")


def m5_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cut(_typed(spark, sf_dir))
    return trainer.verify(_mapping(spark), trainer.topology(n), n.select(F.col("type").alias("tag")))


def m7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cut(trainer.topology(_typed(spark, sf_dir)))
    return trainer.audit(t, _mapping(spark), trainer.deduce(t))


def m6_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the outlines of the python files have otherwise than those of the php files."""
    n = _nodes(spark, sf_dir).select("path", "tag", "name")
    return trainer.golden_diff(n.where("path like '%.py'"), n.where("path like '%.php'"))


def i13_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily batches of each type of events."""
    return telemetry.emitted(table(spark, sf_dir, "events"), "event_type", "ts").withColumnRenamed("at", "sent")


def i14_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the props of events only k, and only where it is a number up to fifty."""
    return telemetry.scrubbed(table(spark, sf_dir, "events").select("event_id", "props"), {"k": 50, "name": "token", "on": "flag"})


def recent_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by decayed use, less those that have as good as stopped."""
    from prism.operators import maintenance

    d = maintenance.decayed(table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-04-01").cast("timestamp"))
    return telemetry.recent(d, 1.0).select("user_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (pattern_run, query_builder, g7_merged_policy, g9_preview, a25_topology, m5_verify, m7_audit, m6_golden, i13_emitted, i14_scrubbed, recent_use)}

_SUF = "list_transform(range(1, len(string_split({0}, '.')) + 1), lambda i: array_to_string(list_slice(string_split({0}, '.'), i, 99), '.'))"
_TY = _NODES.rstrip() + """, ty as (select path, pre, end_pre, parent_pre, tag as type from nodes), pa as (select c.type, p.type as k, count(*) as n from ty c join ty p on p.path = c.path and p.pre = c.parent_pre group by 1, 2),
an as (select type, k, count(*) as n from (select distinct c.path, c.pre, c.type, a.type as k from ty c join ty a on a.path = c.path and c.pre > a.pre and c.pre <= a.end_pre) group by 1, 2),
fi as (select p.type, c.type as k, count(distinct (p.path, p.pre)) as n from ty c join ty p on p.path = c.path and p.pre = c.parent_pre group by 1, 2), b as (select type, count(*) as n, count(distinct path) as files from ty group by 1)"""
_TOLD = lambda t: f"coalesce((select string_agg(k || ':' || n, ',' order by k) from {t} where {t}.type = b.type), '')"


def _oracle_verdicts() -> str:
    from prism.plans.upkeep import _RE2, _fires

    rules, _ = policy.merge([policy.check_policy(POLICY, "project")])
    _RE2.update({r.id: r.pattern for r in rules if r.id not in _RE2})
    clean = "text"
    for r in rules:
        if r.replacement is not None and r.standard == screen.S:
            clean = f"case when {_fires(r.id, 'text')} then regexp_replace({clean}, '{_RE2[r.id].replace(chr(39), chr(39) * 2)}', '{r.replacement}', 'g') else {clean} end"
    some = lambda actions, text: " or ".join(_fires(r.id, text) for r in rules if r.standard in actions)
    return f"""with d as (select coalesce(text, '') as text from documents), c as (select *, {some((screen.Q,), "text")} as block, {some((screen.S,), "text")} as change, {clean} as cleaned from d)
select case when block then 'quarantine' when not change then 'pass' when {some((screen.S, screen.Q), "cleaned")} or trim(cleaned) = '' then 'quarantine' else 'sanitize' end as verdict, count(*) as n from c group by 1"""


ORACLE = {
    "pattern_run": _NODES + f"select path, pre, name from nodes m where tag = 'method' and doc is not null and contains(signature, '(') and len(list_filter({_SUF.format('name')}, lambda s: regexp_matches(s, '^.*\\.(get|load|run)'))) > 0 and path in (select path from files where has_syntax_errors = 1) and exists (select 1 from nodes c where c.path = m.path and c.pre = m.parent_pre and c.tag = 'class')",
    "query_builder": _NODES + f"select path, pre, name from nodes m where tag in ('function', 'method', 'constructor') and len(list_filter({_SUF.format('name')}, lambda s: s like '%Graph')) > 0 and exists (select 1 from nodes c where c.path = m.path and m.pre > c.pre and m.pre <= c.end_pre and c.tag = 'class' and c.exported = 1)",
    "g7_merged_policy": _oracle_verdicts(),
    "g9_preview": "select doc_id as id, case when trim(regexp_replace(text, '(?i)\\bstale (parser|graph)s?\\b', '[gone]', 'g')) = '' then 'quarantine' else 'sanitize' end as verdict, 'word-of-the-day' as rules, regexp_extract(text, '(?i)\\bstale (parser|graph)s?\\b') as excerpts from documents where regexp_matches(text, '(?i)\\bstale (parser|graph)s?\\b')",
    "a25_topology": _TY + f" select type, n as count, files, {_TOLD('pa')} as parents, {_TOLD('an')} as ancestors, {_TOLD('fi')} as fields from b",
    "m5_verify": _NODES + "select t as tag, (select count(*) from nodes where tag = t) as expected, (select count(*) from nodes where tag = t) as found from (values ('class'), ('function'), ('method'), ('constant')) v(t)",
    "m7_audit": _NODES + "select tag as type, count(*) as count, null::varchar as candidate from nodes where tag not in ('class', 'function', 'method', 'constant') group by 1",
    "m6_golden": _NODES + ", x as (select tag, name, count(*) filter (where path like '%.py') as before, count(*) filter (where path like '%.php') as after from nodes group by 1, 2) select * from x where before <> after",
    "i13_emitted": """with recursive e as (select event_type as key, epoch_us(ts) // 1000 as t from events), r as (select key, min(t) as sent, null::bigint as prev from e group by 1 union all select r.key, (select min(e.t) from e where e.key = r.key and e.t - r.sent >= 86400000), r.sent from r where exists (select 1 from e where e.key = r.key and e.t - r.sent >= 86400000))
select key, sent, (select count(*) from e where e.key = r.key and e.t <= r.sent and (r.prev is null or e.t > r.prev)) as events from r""",
    "i14_scrubbed": "select event_id, case when try_cast(props->>'$.k' as double) between 0 and 50 then (props->>'$.k')::double end as k, case when json_type(props->'$.name') = 'VARCHAR' then props->>'$.name' end as name, case when json_type(props->'$.on') = 'BOOLEAN' then (props->>'$.on')::boolean end as \"on\" from (select event_id, props::json as props from events)",
    "recent_use": "select * from (select user_id, round(sum(pow(2.0, -(epoch_us(timestamp '2024-04-01') - epoch_us(ts)) / (86400000000.0 * 14))), 6) as score from events group by 1) where score >= 1",
}
