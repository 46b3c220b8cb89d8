"""Queries of the workspace, the index as tables, fragments, maps and comparison with truth, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.operators import evaluation, fragments, graph, maintenance, screen, store, workspace
from prism.operators.incremental import normal_digest
from prism.plans import searches
from prism.plans.graphs import _STATEMENTS
from prism.plans.upkeep import _fires
from prism.session import cut, table


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").where("path is not null and id is not null").withColumn("kind", F.lower(F.trim("kind"))).distinct()


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("path is not null").select("path").distinct()


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("package_root is not null").select(F.col("package_root").alias("root")).distinct()


# ---- comparison with truth


def a20_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that the cards speak of against those of the files, as multisets of file, name and group of kinds."""
    key = ["path", "name", "grp"]
    s = _symbols(spark, sf_dir)
    truth = s.select("path", F.col("base_name").alias("name"), evaluation.group_of(F.col("kind")).alias("grp")).where("grp is not null")
    c = searches.cards(spark, sf_dir).where("channel = 'symbols' and symbol is not null").select("id", "path", "symbol", "kind").distinct()
    ours = c.select("path", F.substring_index("symbol", ".", -1).alias("name"), evaluation.group_of(F.col("kind")).alias("grp")).where("grp is not null")
    r = evaluation.precision_recall(evaluation.multiset_diff(truth, ours, key), "grp")
    return r.select("grp", "matched", "truth", "ours", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def j30_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name stands in the python files and in the php files."""
    s = _symbols(spark, sf_dir).select("path", "id", "base_name")
    return evaluation.multiset_diff(s.where("path like '%.py'"), s.where("path like '%.php'"), ["base_name"])


def a24_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as files tells them against those of the extension, row by row of a path."""
    f = table(spark, sf_dir, "files").where("path is not null and language is not null").select("path", F.lower(F.trim("language")).alias("language"), "seen_at").distinct()
    t = table(spark, sf_dir, "file_texts").where("path is not null and content is not null").select("path", "content").distinct().select("path", workspace.language_of(F.col("path")).alias("language"), F.md5("content").alias("o"))
    number = F.unix_micros("seen_at").cast("decimal(20,0)").cast("string")
    return evaluation.confusion(evaluation.paired(f.withColumn("o", F.lpad(number, 20, "0")), t, ["path"], ["o", "language"], "language"))


def e1_own_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.own_queries(_symbols(spark, sf_dir)).select("population", "text", "symbol")


def e1_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files answer each query."""
    s = _symbols(spark, sf_dir)
    return evaluation.relevant_files(evaluation.own_queries(s), s).groupBy("population", "text").agg(F.count("*").alias("files"))


def e5_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file asked for its symbols: what the cards have, against the index; items of another kind are wrong."""
    want = _symbols(spark, sf_dir).select(F.col("path").alias("query_id"), F.col("id").alias("item"), F.col("kind").alias("confidence")).dropDuplicates(["query_id", "item"])
    got = searches.cards(spark, sf_dir).where("channel = 'symbols'").select(F.col("path").alias("query_id"), F.regexp_replace("id", r"~\d+$", "").alias("item"), F.col("kind").alias("confidence")).dropDuplicates(["query_id", "item"])
    a = evaluation.answers(want, got)
    return a.select("query_id", "passed", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), F.array_join("wrong", ",").alias("wrong"))


def w10_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents of each source, spread evenly over their ids (a sample is what the operator gives)."""
    return evaluation.spread(table(spark, sf_dir, "documents").select("source", "doc_id"), 100, ["doc_id"], ["source"])


def e7_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and build of each repository."""
    f = maintenance.current_files(table(spark, sf_dir, "files")).withColumn("language", F.lower(F.trim("language")))
    per = f.groupBy("repo", "language").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    share = per.groupBy("repo").agg(F.sum("bytes").alias("all"), F.sum("n").alias("files"))
    major = per.join(share, "repo").where(F.col("bytes") >= 0.1 * F.col("all")).groupBy("repo").agg(F.count("*").alias("major"))
    packs = f.groupBy("repo").agg(F.countDistinct("package_root").alias("packages"))
    j = share.join(major, "repo", "left").join(packs, "repo").fillna(0, ["major"])
    return j.select("repo", "files", evaluation.complexity(F.col("files")).alias("complexity"), evaluation.structure(F.col("packages"), F.lit(False), F.col("major")).alias("structure"))


# ---- the index as tables


def s8_find_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store.find_symbols(_symbols(spark, sf_dir), prefix="s", kinds=["function", "class"], exported_only=True)
    return s.select("path", "seq", "id", "name", "kind")


def s11_find_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.find_like(_symbols(spark, sf_dir), "run").select("path", "id", "name")


def s9_replace_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The python files replaced by their classes alone, the php files removed."""
    s = _symbols(spark, sf_dir).select("path", "id", "kind")
    return store.replace_units(s, s.where("path like '%.py' and kind = 'class'"), removed=s.where("path like '%.php' or path like '%.py'").select("path"))


def u1_with_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("path", "size", "content_hash").distinct()
    both = store.with_quarantined(f.where("content_hash is not null"), f.where("content_hash is null").drop("content_hash"))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def u7_shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the first of three tiers that has them."""
    s = _symbols(spark, sf_dir).select("path", "base_name", "id")
    return store.shadowed([s.where("path like '%.ts'"), s.where("path like '%.py'"), s.where("path like '%.php'")], "base_name").select("base_name", "id", "tier")


def _state(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The files as of the nth succeeded run."""
    runs = table(spark, sf_dir, "runs").where("status = 'succeeded'").select("run_id", "started_at").distinct().orderBy("started_at").limit(n).collect()
    f = table(spark, sf_dir, "files").withColumn("content_hash", normal_digest("content_hash"))
    return maintenance.current_files(f, F.lit(runs[-1]["started_at"]))


def i8_channel_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a channel must do between two runs; its php cards were made by an older version."""
    stored = _state(spark, sf_dir, 1).select("path", F.col("content_hash").alias("digest"), F.when(F.col("path").endswith(".php"), "1").otherwise("2").alias("version"), F.lit("m").alias("model"))
    return store.channel_sync(_state(spark, sf_dir, 3).select("path", F.col("content_hash").alias("digest")), stored, "2", "m")


def i10_to_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = (_state(spark, sf_dir, n).select("path", F.col("content_hash").alias("digest")) for n in (3, 1))
    return store.to_refresh(now, then)


def j33_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stale(_state(spark, sf_dir, 1), _state(spark, sf_dir, 3).where("path not like '%.json'"))


def h19_resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id, name, base name, and the middle line of every file as a target."""
    s = _symbols(spark, sf_dir)
    mid = s.groupBy("path").agg(F.floor(F.max("end_line") / 2).alias("l")).select(F.concat_ws(":", "path", "l"))
    t = s.select("id").union(s.select("name")).union(s.select("base_name")).union(mid).toDF("target")
    return store.resolve_target(s, t)


# ---- the workspace


def j26_package_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.package_of(_paths(spark, sf_dir), _roots(spark, sf_dir))


def a28_walk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.walk_summary(maintenance.current_files(table(spark, sf_dir, "files")))


IGNORE = "# folders and files\ntests/\n*.json\n!rank.json\nlib/**/card*.ts\n/*/*/app\n!/*/*/app/digest.php\n"


def s3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that an ignore file leaves; what an ignored folder holds stays out although it is named again."""
    layers = [("", workspace.ignore_rules(IGNORE)), ("hetare/core-base", workspace.ignore_rules("!tests/\n*.js\n"))]
    return _paths(spark, sf_dir).where(~workspace.ignored(F.col("path"), layers))


def s4_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.expand(_paths(spark, sf_dir), ["**/src/*.ts", "*/*/lib/**", "!**/*_test.*", "!**/c*.py"])


def s5_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "file_texts").where("path is not null and content is not null").select("path", F.encode("content", "UTF-8").alias("content")).distinct()
    return workspace.decoded(t).select("path", "digest", "binary", "lossy", F.length("text").alias("n"))


def channel_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = workspace.claimed(_paths(spark, sf_dir), {"scripts": r"\.[jt]s$", "tests": r"(^|/)tests?/", "config": r"\.json$"})
    return c.groupBy("channel").agg(F.count("*").alias("n"))


def h20_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that contains each symbol, over any number of steps."""
    s = _symbols(spark, sf_dir)
    e = s.where("parent_id is not null").select(F.col("id").alias("name"), F.col("parent_id").alias("dependency"))
    return workspace.closure(e, s.select(F.col("id").alias("name")))


# ---- fragments


def j27_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages as fragments, index files named by one of their own, broken files overridden."""
    f = table(spark, sf_dir, "files")
    roots = _roots(spark, sf_dir).select("root", F.col("root").alias("fragment"))
    named = _paths(spark, sf_dir).where("path like '%/main.%' or path like '%/group.%'").withColumn("fragment", F.lit("named"))
    broken = f.where("has_syntax_errors = 1").select("path").distinct().withColumn("fragment", F.lit("broken"))
    return fragments.assign(_paths(spark, sf_dir), roots, named, broken)


def h14_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.by_folder(_paths(spark, sf_dir), _roots(spark, sf_dir))


def h15_by_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of the repositories by the names they share, where each is named by its owner."""
    from prism.plans.graphs import _same_name

    return fragments.by_imports(_paths(spark, sf_dir), _same_name(spark, sf_dir)).groupBy("fragment").agg(F.count("*").alias("files"))


def a31_dominant_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir).select(F.col("base_name").alias("group"), "path").where("base_name is not null").distinct()
    return fragments.dominant_directory(s)


def h16_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose shard (their repository) is not the fragment they belong to (their package), and by how many."""
    p = _paths(spark, sf_dir)
    assigned = j27_assign(spark, sf_dir)
    actual = p.select("path", F.substring_index("path", "/", 2).alias("fragment"))
    j, orphans = fragments.drift(assigned, actual, _roots(spark, sf_dir).select(F.col("root").alias("id")))
    return j.groupBy("actual").agg(F.count("*").alias("files")).join(orphans.select(F.col("shard").alias("actual"), F.lit(True).alias("orphan")), "actual", "left").select("actual", "files", F.coalesce("orphan", F.lit(False)).alias("orphan"))


# ---- maps, spans, propagation


def _contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members as callers of what contains them: an invented graph to try the map on."""
    return _symbols(spark, sf_dir).where("parent_id is not null").select(F.col("id").alias("source_path"), F.col("parent_id").alias("to_ref"), F.lit("calls").alias("kind"))


def h12_map_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of the map: ranks are known of classes alone, the others fall back."""
    e = _contained(spark, sf_dir)
    ranks = e.groupBy(F.col("to_ref").alias("ref")).agg((F.count("*") / 10.0).alias("score"))
    m = graph.map_symbols(_symbols(spark, sf_dir), e, ranks)
    return m.select("path", "id", "callers", F.round("score", 6).alias("score"), "place")


def h12_map_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _contained(spark, sf_dir)
    return graph.map_cost(graph.map_symbols(_symbols(spark, sf_dir), e, e.groupBy(F.col("to_ref").alias("ref")).agg((F.count("*") / 10.0).alias("score"))))


def h12_map_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = maintenance.current_files(table(spark, sf_dir, "files")).select("path", F.col("size").cast("double").alias("score"))
    return graph.map_tree(f, 4)


def j7_smallest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the line in the middle of each file, the smallest symbol that spans it."""
    s = _symbols(spark, sf_dir)
    p = s.groupBy("path").agg(F.floor(F.max("end_line") / 2).cast("int").alias("line")).select(F.col("path").alias("point"), "path", "line")
    return graph.smallest_span(p, s).select("path", "line", "id")


def h18_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of symbols mixed with those of what contains them; two places of each."""
    v = searches.vectors(spark, sf_dir, "symbols").select("id", F.col("group_key").alias("grp"), "vector")
    parents = _symbols(spark, sf_dir).select("id", "parent_id").distinct()
    none = parents.limit(0).toDF("a", "b")
    return graph.propagated(v, none, parents, 0.5).select("id", F.round(F.col("vector")[0], 5).alias("x"), F.round(F.col("vector")[1], 5).alias("y"))


def j32_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of which repository name each file by an import."""
    from prism.operators import resolve

    i = resolve.imports(table(spark, sf_dir, "file_texts")).where("path not like '%.py'").select(F.substring_index("path", "/", 2).alias("repo"), "path", "specifier")
    return graph.federated_dependents(i, _paths(spark, sf_dir).where("path not like '%.json'").select(F.col("path").alias("host"))).groupBy("host").agg(F.count("*").alias("n"))


def v12_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each file does not come up in the hundred nearest cards of the stated query."""
    f = table(spark, sf_dir, "files").where("path is not null").groupBy("path").agg(F.max("content_hash").alias("h"))
    states = f.select("path", F.when(F.col("h").isNull(), "quarantined").otherwise("indexed").alias("status"))
    c = cut(searches.cards(spark, sf_dir).where("channel = 'symbols'"))
    held = c.select("path", F.exists(screen.findings(F.col("text"), "strict"), lambda x: x["action"] == screen.Q).alias("quarantined"))
    hits = searches.search.retrieve(searches.vectors(spark, sf_dir, "symbols"), searches.asked_vector(spark, sf_dir), 100)
    ranked = searches.search.lane_of(hits.join(c.select("id", "path").distinct(), "id").withColumn("key", F.col("path")), [F.desc("score"), F.asc("id")]).select(F.col("key").alias("path"), F.col("pos").alias("rank"))
    return graph.diagnose(states.select("path"), states, held, ranked)


def a30_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by their cards, most first."""
    return table(spark, sf_dir, "cards").where("id is not null and model is not null").select("channel", "id", "model").distinct().groupBy("model").agg(F.count("*").alias("cards")).orderBy(F.desc("cards"), "model")


QUERIES = {f.__name__: f for f in (a20_precision_recall, j30_multiset_diff, a24_confusion, e1_own_queries, e1_relevant, e5_answers, w10_spread, e7_structure, s8_find_symbols, s11_find_like, s9_replace_units, u1_with_quarantined, u7_shadowed, i8_channel_sync, i10_to_refresh, j33_stale, h19_resolve_target, j26_package_of, a28_walk_summary, s3_kept, s4_expand, s5_decoded, channel_claims, h20_closure, j27_assign, h14_by_folder, h15_by_imports, a31_dominant_directory, h16_misplaced, h12_map_symbols, h12_map_cost, h12_map_tree, j7_smallest_span, h18_propagated, j32_federated, v12_diagnose, a30_models)}

_SY = "sy as (select distinct * replace (lower(trim(kind)) as kind) from symbols where path is not null and id is not null)"
_GRP = "case {0} " + " ".join(f"when '{k}' then '{g}'" for k, g in evaluation.GROUPS.items()) + " end"
_LANG = "case lower(regexp_extract({0}, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"when '{e}' then '{n}'" for e, n in workspace.LANGUAGES.items()) + " end"
_CUR = "(select * from (select *, row_number() over (partition by path order by seen_at desc, loaded_at desc) as rn from files where content_hash is not null and path is not null {0}) where rn = 1)"
_DG = "regexp_replace(lower(trim(content_hash)), '^[a-z][a-z0-9_-]*[:=]', '')"
_AT = "and loaded_at <= (select started_at from (select started_at, row_number() over (order by started_at) as n from (select distinct run_id, started_at from runs where status = 'succeeded')) where n = {0})"
_ST = f"s1 as (select *, {_DG} as digest from {_CUR.format(_AT.format(1))}), s3 as (select *, {_DG} as digest from {_CUR.format(_AT.format(3))})"
_EW = lambda c: f"list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w))"
_FS = "trim(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(doc, '\\r?\\n'), lambda l: trim(regexp_replace(l, '^\\s*(/\\*\\*?|\\*/|\\*|///?|#)\\s?', ''))), lambda l: l <> '' and l not like '@%'), ' '), '(?s)[.!?](\\s.*|$)', ''))"
_OQ = f"""{_SY}, ns as (select * from sy where not regexp_matches(path, '{evaluation.TEST_PATH}') and base_name is not null),
nm as (select base_name, arg_min(id, (path, seq, id)) as id, arg_min(kind, (path, seq, id)) as kind from ns where exported = 1 and len({_EW("base_name")}) >= 2 group by 1),
it as (select id, path, base_name, list_filter({_EW(_FS)}, lambda w: not list_contains({_EW("base_name")}, w)) as t from ns where doc is not null),
oq as (select 'identifier' as population, array_to_string({_EW("base_name")}, ' ') as text, id as symbol, base_name from nm union all select 'exact-name', '//' || kind || '[@name="' || base_name || '"][@declaration]', id, base_name from nm union all select 'intent', array_to_string(t, ' '), id, base_name from it where len(t) >= 5)"""
_UPS = "unnest(list_transform(range(0, len(string_split({0}, '/'))), lambda n: array_to_string(string_split({0}, '/')[1:n], '/')))"
_PK = "pk as (select distinct package_root as root from files where package_root is not null), fp as (select distinct path from files where path is not null)"
_RK = f"{_SY}, ce as (select parent_id as r, count(*) as n from sy where parent_id is not null group by 1), ms as (select d.path, d.id, d.name, d.kind, d.line, d.signature, coalesce(a.n, b.n, 0) as callers, coalesce(a.n / 10.0, b.n / 10.0, 0) as score from (select distinct path, id, name, kind, start_line as line, signature from sy) d left join ce a on a.r = d.id left join ce b on b.r = d.name), mp as (select *, row_number() over (partition by path order by score desc, callers desc, line, id) as place from ms qualify place <= 5)"
_ASS = f"""{_PK}, br as (select distinct path from files where has_syntax_errors = 1 and path is not null), dp as (select path, arg_max(root, length(root)) as root from (select path, {_UPS.format("path")} as root from fp) join pk using (root) group by 1),
sg as (select fp.path, case when br.path is not null then 'broken' when fp.path like '%/main.%' or fp.path like '%/group.%' then 'named' else coalesce(dp.root, 'root') end as fragment from fp left join br using (path) left join dp using (path))"""

ORACLE = {
    "a20_precision_recall": f"""with {_SY}, {searches._C}, t as (select path, base_name as name, {_GRP.format("kind")} as grp, count(*) as n from sy group by 1, 2, 3), o as (select path, name, grp, count(*) as n from (select distinct id, path, string_split(symbol, '.')[-1] as name, {_GRP.format("kind")} as grp, kind, symbol from c where channel = 'symbols' and symbol is not null) group by 1, 2, 3),
jj as (select coalesce(t.grp, o.grp) as grp, coalesce(t.n, 0) as tn, coalesce(o.n, 0) as n from (select * from t where grp is not null) t full join (select * from o where grp is not null) o on t.path = o.path and t.name = o.name and t.grp = o.grp)
select grp, sum(least(tn, n))::long as matched, sum(tn)::long as truth, sum(n)::long as ours, round(sum(least(tn, n)) / nullif(sum(n), 0), 6) as precision, round(sum(least(tn, n)) / nullif(sum(tn), 0), 6) as recall from jj group by rollup(grp)""",
    "j30_multiset_diff": f"with {_SY}, t as (select base_name, count(*) as n from (select distinct path, id, base_name from sy where path like '%.py') group by 1), o as (select base_name, count(*) as n from (select distinct path, id, base_name from sy where path like '%.php') group by 1) select coalesce(t.base_name, o.base_name) as base_name, coalesce(t.n, 0) as truth, coalesce(o.n, 0) as ours, least(coalesce(t.n, 0), coalesce(o.n, 0)) as matched from t full join o on t.base_name = o.base_name",
    "a24_confusion": f"""with a as (select path, language, row_number() over (partition by path order by seen_at, language) as n from (select distinct path, lower(trim(language)) as language, seen_at from files where path is not null and language is not null)),
b as (select path, language, row_number() over (partition by path order by md5(content), language) as n from (select distinct path, content, {_LANG.format("path")} as language from file_texts where path is not null and content is not null))
select a.language || '>' || b.language as outcome, count(*) as n from a join b on a.path = b.path and a.n = b.n group by 1""",
    "e1_own_queries": f"with {_OQ} select population, text, symbol from oq",
    "e1_relevant": f"with {_OQ}, rf as (select distinct population, text, ns.path from oq join ns using (base_name) where population <> 'intent' union select distinct population, text, sy.path from oq join sy on sy.id = oq.symbol where population = 'intent') select population, text, count(*) as files from rf group by 1, 2",
    "e5_answers": f"""with {_SY}, {searches._C}, w as (select path as q, id as item, any_value(kind) as k from sy group by 1, 2), g as (select path as q, regexp_replace(id, '~\\d+$', '') as item, any_value(kind) as k from c where channel = 'symbols' group by 1, 2),
jj as (select coalesce(w.q, g.q) as q, coalesce(w.item, g.item) as item, g.q is null as mi, w.q is null as un, w.k is not null and g.q is not null and w.k is distinct from g.k as wr from w full join g on w.q = g.q and w.item = g.item)
select q as query_id, not bool_or(mi or un or wr) as passed, coalesce(string_agg(item, ',' order by item) filter (where mi), '') as missing, coalesce(string_agg(item, ',' order by item) filter (where un), '') as unexpected, coalesce(string_agg(item, ',' order by item) filter (where wr), '') as wrong from jj where q in (select q from w) group by 1""",
    "w10_spread": "with d as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents) select source, doc_id from d where n <= 100 or i in (select (j * d.n) // 100 from range(100) t(j))",
    "e7_structure": f"""with f as (select *, lower(trim(language)) as l from {_CUR.format('')}), p as (select repo, l, sum(size) as b from f group by 1, 2), s as (select repo, sum(size) as a, count(*) as files, count(distinct package_root) as packages from f group by 1), m as (select repo, count(*) as major from p join s using (repo) where b >= 0.1 * a group by 1)
select repo, files, case when files < 300 then 'small' when files < 3000 then 'medium' when files < 20000 then 'large' else 'huge' end as complexity, case when packages >= 3 then 'monorepo' when coalesce(major, 0) >= 3 then 'polyglot' when packages > 0 then 'nested' else 'single' end as structure from s left join m using (repo)""",
    "s8_find_symbols": f"with {_SY} select path, seq, id, name, kind from sy where name like 's%' and kind in ('function', 'class') and exported = 1",
    "s11_find_like": f"with {_SY} select path, id, name from sy where name like '%run'",
    "s9_replace_units": f"with {_SY} select path, id, kind from sy where path not like '%.php' and (path not like '%.py' or kind = 'class')",
    "u1_with_quarantined": "select case when content_hash is null then 'quarantined' else 'indexed' end as status, count(*) as n, sum(size)::long as bytes from (select distinct path, size, content_hash from files) group by 1",
    "u7_shadowed": f"with {_SY}, t as (select base_name, id, case when path like '%.ts' then 0 when path like '%.py' then 1 else 2 end as tier from sy where regexp_matches(path, '\\.(ts|py|php)$')) select base_name, id, tier from t qualify tier = min(tier) over (partition by base_name)",
    "i8_channel_sync": f"with {_ST} select coalesce(s3.path, s1.path) as path, case when s3.path is null then 'delete' when s3.digest = s1.digest and s1.path not like '%.php' then 'unchanged' else 'upsert' end as action from s3 full join s1 on s1.path = s3.path",
    "i10_to_refresh": f"with {_ST} select path from s3 left join s1 using (path) where s1.digest is null or s1.digest <> s3.digest",
    "j33_stale": f"with {_ST}, z as (select * from s3 where path not like '%.json') select path, case when z.path is null then 'removed' else 'changed' end as reason from s1 left join z using (path) where z.path is null or z.size <> s1.size or z.mtime_ms <> s1.mtime_ms" .replace("select path, case", "select s1.path, case"),
    "h19_resolve_target": f"""with {_SY}, md as (select path, (max(end_line) // 2)::int as l from sy group by 1), t as (select id as target from sy union select name from sy union select base_name from sy union select path || ':' || l from md), tt as (select target from t where target is not null),
w as (select tt.target, 0 as w, 'id' as how, id from tt join sy on sy.id = tt.target union select md.path || ':' || md.l, 1, 'line', arg_max(id, (start_line, -end_line, id)) from md join sy on sy.path = md.path and md.l between start_line and end_line group by 1 union select target, 2, 'name', id from tt join sy on sy.name = tt.target union select target, 3, 'base name', id from tt join sy on sy.base_name = tt.target),
g as (select target, w, how, count(distinct id) as found, min(id) as id from w group by 1, 2, 3), b as (select * from g qualify w = min(w) over (partition by target))
select tt.target, coalesce(how, 'none') as how, coalesce(found, 0) as found, case when found = 1 then id end as id from tt left join b using (target)""",
    "j26_package_of": f"with {_PK}, u as (select path, {_UPS.format('path')} as root from fp) select fp.path, d.root from fp left join (select path, arg_max(root, length(root)) as root from u join pk using (root) group by 1) d using (path)",
    "a28_walk_summary": f"select {_LANG.format('path')} as language, package_root, count(*) as files, sum(size)::long as bytes from {_CUR.format('')} group by 1, 2",
    "s3_kept": """select distinct path from files where path is not null and not regexp_matches(path, '^[^/]+/[^/]+/app/') and not (regexp_matches(path, '(^|/)tests/') and path not like 'hetare/core-base/tests/%' and not regexp_matches(path, '^hetare/core-base/(.*/)?tests/[^/]*$'))
 and not (path like '%.json' and path not like '%/rank.json') and not regexp_matches(path, '^lib/(.*/)?card[^/]*\\.ts$') and not (path like 'hetare/core-base/%.js')""",
    "s4_expand": "select distinct path from files where (regexp_matches(path, '^(.*/)?src/[^/]*\\.ts$') or regexp_matches(path, '^[^/]+/[^/]+/lib/.+')) and not regexp_matches(path, '^(.*/)?[^/]*_test\\.[^/]*$') and not regexp_matches(path, '^(.*/)?c[^/]*\\.py$')",
    "s5_decoded": "select distinct path, sha256(content) as digest, contains(content[1:8000], chr(0)) as binary, false as lossy, length(regexp_replace(content, '^﻿', '')) as n from file_texts where path is not null and content is not null",
    "channel_claims": "select channel, count(distinct path) as n from (select 'scripts' as channel, path from files where regexp_matches(path, '\\.[jt]s$') union all select 'tests', path from files where regexp_matches(path, '(^|/)tests?/') union all select 'config', path from files where path like '%.json') group by 1",
    "h20_closure": f"with recursive {_SY}, e as (select distinct id, parent_id from sy where parent_id is not null), r as (select id as name, parent_id as reached from e union select r.name, e.parent_id from r join e on e.id = r.reached) select distinct name, reached from r where name <> reached",
    "j27_assign": f"with {_ASS} select path, fragment from sg",
    "a31_dominant_directory": f"""with {_SY}, m as (select distinct base_name as g, path from sy where base_name is not null), s as (select g, count(*) as files from m group by 1), u as (select g, d, count(*) as n from (select g, {_UPS.format("path")} as d from m) where d <> '' group by 1, 2),
b as (select g, arg_min(d, (-len(string_split(d, '/')), -n, d)) as d from u join s using (g) where n * 2 >= files group by 1) select s.g as "group", coalesce(d, '') as folder from s left join b using (g)""",
    "h14_by_folder": f"""with {_PK}, h as (select path, root from (select path, {_UPS.format("path")} as root from fp) join pk using (root) where root <> ''), r as (select distinct root, string_split(root, '/')[-1] as b from h), n as (select root, case when count(*) over (partition by b) > 1 then root else b end as name, 0 as o from r),
f as (select distinct string_split(path, '/')[1] as root from fp where path not in (select path from h) and contains(path, '/')), a as (select * from n union all select root, root, 1 from f where root not in (select string_split(root, '/')[1] from r)),
g as (select *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as s from a) select case when k = 1 then s else s || '-' || k end as id, root from (select *, row_number() over (partition by s order by o::varchar || '/' || root) as k from g)""",
    "h16_misplaced": f"with {_ASS}, j as (select string_split(path, '/')[1] || '/' || string_split(path, '/')[2] as actual, fragment from sg) select actual, count(*) as files, actual not in (select root from pk) as orphan from j where actual <> fragment group by 1",
    "h12_map_symbols": f"with {_RK} select path, id, callers, round(score, 6) as score, place from mp",
    "h12_map_cost": f"with {_RK} select path, sum(4 * len(string_split(path, '/')) + 8 + length(kind) + length(name) + coalesce(length(signature), 0) + 14)::long as symbols_chars from mp group by 1",
    "h12_map_tree": f"""with f as (select path, size::double as score, string_split(path, '/') as p from {_CUR.format('')}), u as (select array_to_string(p[1:n], '/') as path, n < len(p) as is_dir, score, n, len(p) as l from (select *, unnest(range(1, len(p) + 1)) as n from f))
select path, is_dir, max(score) as score from u where case when is_dir then n <= 4 else l - 1 <= 4 end group by 1, 2""",
    "j7_smallest_span": f"with {_SY}, s as (select distinct path, id, start_line, end_line, seq from sy), m as (select path, (max(end_line) // 2)::int as line from s group by 1) select m.path, m.line, arg_min(id, (end_line - start_line, seq, id)) as id from m left join s on s.path = m.path and line between start_line and end_line group by 1, 2",
    "h18_propagated": f"""with {_SY}, {searches._U}, v as (select id, group_key as grp, u from vu where channel = 'symbols'), gs as (select grp, list(x order by i) as s from (select grp, i, sum(x) as x from (select grp, unnest(u) as x, generate_subscripts(u, 1) as i from v) group by 1, 2) group by 1),
gv as (select grp, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) as v from gs), l0 as (select distinct id as a, parent_id as b from sy where parent_id is not null and id <> parent_id), l as (select a, b from l0 union select b, a from l0),
m as (select a as grp, list(x order by i) as mean from (select a, i, avg(x) as x from (select a, unnest(v) as x, generate_subscripts(v, 1) as i from l join gv on gv.grp = l.b where a in (select grp from gv)) group by 1, 2) group by 1),
r as (select id, case when mean is null then u else list_transform(list_zip(u, mean), lambda z: z[1] + 0.5 * z[2]) end as w, mean is null as own from v left join m using (grp)) select id, round(case when own then w[1] else w[1] / sqrt(list_dot_product(w, w)) end, 5) as x, round(case when own then w[2] else w[2] / sqrt(list_dot_product(w, w)) end, 5) as y from r""",
    "j32_federated": f"""with {_STATEMENTS}, sp as (select distinct scope as repo, path, list_filter(string_split(spec, '/'), lambda x: x not in ('', '.')) as p from js where spec <> ''), i as (select distinct repo, path, coalesce(regexp_replace(p[-1], '\\.[^.]+$', ''), '') as last, case when len(p) > 1 then p[-2] end as parent from sp),
h as (select distinct path as host, regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') as stem, case when contains(path, '/') then string_split(path, '/')[-2] else '' end as folder from files where path is not null and path not like '%.json')
select host, count(*) as n from (select distinct host, repo, path from h join i on (stem <> 'index' and last = stem) or (stem = 'index' and (last = folder or (last = 'index' and parent = folder)))) group by 1""",
    "v12_diagnose": (lambda q: f"""with {searches._U}, {searches._C}, st as (select path, case when max(content_hash) is null then 'quarantined' else 'indexed' end as status from files where path is not null group by 1),
hd as (select path, count(*) as n, count(*) filter (where {q}) as held from (select distinct id, path, text, symbol, kind, has_doc, start_line, end_line, group_key, model from c where channel = 'symbols') group by 1),
b as (select id, s from (select id, s, row_number() over (partition by group_key order by s desc, id) as n from (select id, group_key, list_dot_product(u, vq.q) as s from vu, vq where channel = 'symbols')) where n = 1 order by s desc, id limit 100), p as (select path, row_number() over (order by s desc, id) as pos from b join (select distinct id, path from c where channel = 'symbols') using (id)), rk as (select path, min(pos) as rank from p group by 1),
x as (select st.path, case when status <> 'indexed' then 'INDEX' when coalesce(n - held, 0) = 0 and coalesce(held, 0) > 0 then 'RED_TEAM' when coalesce(n - held, 0) = 0 then 'CARDS' when rank is null then 'RANK' end as lost_at, rank from st left join hd using (path) left join rk using (path)) select path, lost_at, case when lost_at is null then rank end as rank from x""")(" or ".join(_fires(r.id, "text") for r in screen.RULES if r.strict == screen.Q)),
    "a30_models": "select model, count(*) as cards from (select distinct channel, id, model from cards where id is not null and model is not null) group by 1",
}
