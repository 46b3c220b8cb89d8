"""Queries over the import graph of the source texts, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.operators import graph, resolve
from prism.session import cut, table


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import statements of the source texts with what they lead to. A workspace is a repository: owner and name."""
    texts, files = table(spark, sf_dir, "file_texts"), table(spark, sf_dir, "files")
    found = resolve.imports(texts).unionByName(resolve.php_uses(texts))
    roots = files.select(F.col("package_root").alias("root")) if "package_root" in files.columns else None
    return resolve.link_imports(found, files, scope_parts=2, roots=roots)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.edges_of(linked(spark, sf_dir))


def import_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relative statement of the scripts: line, specifier, whether it re-exports or only imports types."""
    return resolve.imports(table(spark, sf_dir, "file_texts")).where("relative and path not like '%.py'").select("path", "line", "specifier", "reexport", "type_only")


def h1_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("source_path", "to_ref", "kind", F.array_join("lines", ",").alias("lines"))


def h8_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(_edges(spark, sf_dir), table(spark, sf_dir, "files").select("path"))


def h9_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling(_edges(spark, sf_dir)).select("source_path", "to_ref", F.array_join("lines", ",").alias("lines"))


def a14_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(_edges(spark, sf_dir))


def a15_hub_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve outside modules that most files import."""
    return graph.hubs(_edges(spark, sf_dir), ("imports:external",), 12)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of _edges that lead to a file."""
    return cut(_edges(spark, sf_dir).where(F.col("kind").isin(*graph.IMPORT_KINDS)))


def h7_import_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every imported file, its dependents up to two hops."""
    e = _links(spark, sf_dir)
    return graph.dependents(e, e.select(F.col("to_ref").alias("path")), 2, type_only=True).drop("more")


def h10_import_relink_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to link again when files were added whose syntax is in doubt: their importers and those of dangling imports."""
    changed = table(spark, sf_dir, "files").where("has_syntax_errors = 1").select("path").distinct()
    return graph.relink_set(cut(_edges(spark, sf_dir)), changed, membership_changed=True)


def _file_ranks(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    return graph.pagerank(edges, refs=table(spark, sf_dir, "files").select(F.col("path").alias("ref")))


def h11_import_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_ranks(spark, sf_dir, _links(spark, sf_dir))


def h11_import_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks, rounded as the SQL beside it rounds."""
    return h11_import_pagerank(spark, sf_dir).select("ref", F.round("score", 6).alias("score"))


def h12_import_repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _links(spark, sf_dir)
    return graph.repo_map(e, _file_ranks(spark, sf_dir, e), 1000)


def h12_import_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h12_import_repo_map(spark, sf_dir).withColumn("score", F.round("score", 6))


def _same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a denser graph: a file refers to the file of its repository whose symbols bear the name of its alias, and
    symbols to their container's file. Invented: it tests the operators at size, its results say nothing of imports; those are h*_import_*."""
    s = table(spark, sf_dir, "symbols").select("path", "base_name").distinct()
    first = s.groupBy("base_name").agg(F.min("path").alias("to_ref"))
    return s.join(first, "base_name").where("path <> to_ref").select(F.col("path").alias("source_path"), "to_ref").distinct().withColumn("kind", F.lit("imports"))


def h7_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(_same_name(spark, sf_dir))
    seeds = e.groupBy(F.col("to_ref").alias("path")).agg(F.count("*").alias("n")).where("n >= 5").select("path")
    return graph.dependents(e, seeds, 2)


def h13_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of repositories by the base names that any two of them share."""
    s = table(spark, sf_dir, "symbols").select(F.substring_index("path", "/", 2).alias("node"), F.col("base_name").alias("grp"))
    return graph.shared_communities(s)


def h10_relink_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "files").where("has_syntax_errors = 1").select("path").distinct()
    return graph.relink_set(_same_name(spark, sf_dir), changed)


def h11_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_same_name(spark, sf_dir)).select("ref", F.round("score", 6).alias("score"))


def h12_repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(_same_name(spark, sf_dir))
    return graph.repo_map(e, graph.in_degree(e).select("ref", F.col("importers").cast("double").alias("score")), 1000).select("path", "score", "importers", "used")


QUERIES = {f.__name__: f for f in (import_statements, h1_import_edges, h8_dependencies, h9_dangling, a14_in_degree, a15_hub_modules, h13_communities, h7_dependents, h10_relink_set, h11_pagerank, h12_repo_map, h7_import_dependents, h10_import_relink_set, h11_import_pagerank, h11_import_ranks, h12_import_repo_map, h12_import_map)}

# the statements of each language line by line, every candidate written out, the least that exists
_NORM = "list_reduce(list_filter(string_split({0}, '/'), lambda x: x not in ('', '.')), lambda a, x: case when x = '..' then a[:-2] else list_append(a, x) end, []::varchar[])"
_SCRIPT_EXT = "', '".join(resolve.SCRIPTS)
_STATEMENTS = r"""t as (select distinct path, regexp_replace(content, '\r\n?', chr(10), 'g') as c from file_texts where path is not null and content is not null),
l as (select path, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] as scope, regexp_extract(path, '\.(\w+)$', 1) as ext, unnest(string_split(c, chr(10))) as s, generate_subscripts(string_split(c, chr(10)), 1) as line from t),
js as (select path, scope, line, regexp_extract(s, '^[ \t]*(?:import|export)\s+(?:[^''";]*?\s+from\s+)?[''"]([^''"]+)[''"]', 1) as spec, s like 'export%' as re, regexp_matches(s, '^(?:import|export)\s+type\s+[^f]') as ty from l where ext in ('js', 'ts', 'tsx', 'jsx', 'mjs', 'cjs', 'mts', 'cts')),
py as (select path, scope, line, regexp_extract(s, '^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+[^\n#;]', 1) as spec, list_filter(list_transform(string_split(regexp_extract(s, 'import[ \t]+\(?([^)\n#;]+)', 1), ','), lambda x: regexp_extract(trim(x), '^([\w*]+)', 1)), lambda x: x not in ('', '*')) as names from l where ext = 'py'
 union all select path, scope, line, unnest(list_transform(string_split(m, ','), lambda x: regexp_extract(trim(x), '^([\w.]+)', 1))), []::varchar[] from (select path, scope, line, regexp_extract(s, '^[ \t]*import[ \t]+(\w[\w. \t,]*)', 1) as m from l where ext = 'py') where m <> ''),
ph as (select path, scope, line, regexp_extract(s, '^use\s+(?:function\s+|const\s+)?\\?([\w\\]+)(?:\s+as\s+\w+)?\s*;', 1) as spec from l where ext = 'php')"""
_E1 = f"""with {_STATEMENTS}, k as (select distinct path as cand from files where path is not null),
pk as (select distinct string_split(package_root, '/')[1] || '/' || string_split(package_root, '/')[2] as scope, package_root as root from files where package_root is not null),
jb as (select *, array_to_string({_NORM.format("regexp_replace(path, '/[^/]*$', '') || '/' || spec")}, '/') as b from js where spec like '.%'),
jx as (select *, regexp_extract(b, '[^/](\\.[^./]+)$', 1) as ext from jb),
jc as (select path, line, spec, re, ty, list_concat(case ext when '.js' then [b[:-4] || '.ts', b[:-4] || '.tsx'] when '.jsx' then [b[:-5] || '.tsx'] when '.mjs' then [b[:-5] || '.mts'] when '.cjs' then [b[:-5] || '.cts'] else [] end, [b],
 case when ext in ('{_SCRIPT_EXT}') then [] else list_transform(['{_SCRIPT_EXT}'], lambda e: b || e) end, case when ext in ('{_SCRIPT_EXT}') then [] else list_transform(['{_SCRIPT_EXT}'], lambda e: b || '/index' || e) end) as cs from jx),
ju as (select path, line, spec, re, ty, unnest(cs) as cand, generate_subscripts(cs, 1) as n from jc),
jh as (select path, line, spec, arg_min(cand, n) as hit from ju join k using (cand) group by 1, 2, 3),
pt as (select path, line, spec, names, case when spec like '.%' then [regexp_replace(path, '/[^/]*$', '') || repeat('/..', length(regexp_extract(spec, '^\\.*')) - 1)] else list_concat([scope, scope || '/src'], coalesce((select list(r order by r) from (select unnest([root, root || '/src']) as r from pk where pk.scope = py.scope)), [])) end as tops from py where spec <> ''),
pu as (select path, line, spec, names, unnest(tops) as top, generate_subscripts(tops, 1) as n from pt),
pb as (select *, array_to_string({_NORM.format("top || '/' || replace(regexp_replace(spec, '^\\.+', ''), '.', '/')")}, '/') as b from pu),
pc as (select path, line, spec, b || '.py' as cand, 2 * n as n from pb union all select path, line, spec, b || '/__init__.py', 2 * n + 1 from pb
 union all select path, line, spec, b || '/' || m || e, 1000000 + 1000 * n + i from (select path, line, spec, b, n, unnest(names) as m, generate_subscripts(names, 1) as i from pb), (values ('.py'), ('/__init__.py')) v(e)),
hh as (select path, line, spec, arg_min(cand, n) as hit from pc join k using (cand) group by 1, 2, 3),
e0 as (select js.path, js.line, js.spec, case when hit is not null and re then 'imports:reexport' when hit is not null and ty then 'imports:type' when hit is not null then 'imports' when js.spec like '.%' then 'imports:dangling' else 'imports:external' end as kind,
  coalesce(hit, case when js.spec like '.%' or js.spec like '/%' or js.spec like 'node:%' or js.spec in ('{"', '".join(resolve.RUNTIME)}') then js.spec when js.spec like '@%' then string_split(js.spec, '/')[1] || '/' || string_split(js.spec, '/')[2] else string_split(js.spec, '/')[1] end) as ref from js left join jh using (path, line, spec) where js.spec <> ''
 union all select py.path, py.line, py.spec, case when hit is not null then 'imports' when py.spec like '.%' then 'imports:dangling' else 'imports:external' end, coalesce(hit, case when py.spec like '.%' then py.spec else string_split(py.spec, '.')[1] end) from py left join hh using (path, line, spec) where py.spec <> ''
 union all select path, line, spec, 'imports:external', spec from ph where spec <> ''),
e1 as (select path as source_path, ref as to_ref, kind, array_to_string(list_sort(list(distinct line)), ',') as lines from e0 group by 1, 2, 3)
"""
_E = """s as (select distinct path, base_name from symbols), f as (select base_name, min(path) as to_ref from s group by 1),
e as (select distinct path as source_path, to_ref from s join f using (base_name) where path <> to_ref)"""
_RANK = "\n".join(
    f"r{i + 1} as materialized (select n.ref, 0.15 / (select count(*) from n) + 0.85 * coalesce(sum(r.score / d.d), 0) as score from n left join e on e.to_ref = n.ref left join r{i} r on r.ref = e.source_path left join d on d.source_path = e.source_path group by 1),"
    for i in range(20)
)
_LINK = _E1 + ", e as (select source_path, to_ref from e1 where kind in ('imports', 'imports:type', 'imports:reexport', 'imports:asset')), n as (select source_path as ref from e union select to_ref from e union select path from files where path is not null), d as (select source_path, count(*) as d from e group by 1), r0 as materialized (select ref, 1.0 / (select count(*) from n) as score from n), " + _RANK + " z as (select max(score) as top from r20), rk as (select ref, score / top as score from r20, z)"
ORACLE = {
    "h10_import_relink_set": _E1.replace("with ", "with recursive ", 1) + """, ch as (select distinct path from files where has_syntax_errors = 1), v as (select path from ch union select e1.source_path from v join e1 on e1.to_ref = v.path and e1.kind = 'imports:reexport')
select distinct source_path as path from e1 where (kind = 'imports:dangling' or kind in ('imports', 'imports:type', 'imports:reexport', 'imports:asset') and to_ref in (select path from v)) and source_path not in (select path from ch)""",
    "h11_import_ranks": _LINK + " select ref, round(score, 6) as score from rk",
    "h12_import_map": _LINK + """, i as (select to_ref as path, count(distinct source_path) as importers from e group by 1), x as (select ref as path, round(score, 6) as score, coalesce(importers, 0) as importers, row_number() over (order by score desc, coalesce(importers, 0) desc, ref) as k from rk left join i on i.path = rk.ref),
y as (select *, sum(ceil((length(path) + 16) / 4)) over (order by k)::long as used from x) select path, score, importers, used from y where used <= 1000 or k = 1""",
    "import_statements": f"with {_STATEMENTS} select path, line, spec as specifier, re as reexport, ty as type_only from js where spec like '.%'",
    "h1_import_edges": _E1 + "select * from e1",
    "h8_dependencies": _E1 + "select source_path, to_ref, kind from e1 where kind in ('imports', 'imports:type', 'imports:reexport', 'imports:asset') and source_path in (select path from files)",
    "h9_dangling": _E1 + "select source_path, to_ref, lines from e1 where kind = 'imports:dangling'",
    "a14_in_degree": _E1 + "select to_ref as ref, count(distinct source_path) as importers from e1 group by 1",
    "a15_hub_modules": _E1 + "select to_ref as ref, count(distinct source_path) as users from e1 where kind = 'imports:external' group by 1 order by 2 desc, 1 limit 12",
    "h7_import_dependents": _E1 + """, d as (select distinct source_path, to_ref from e1 where kind in ('imports', 'imports:type', 'imports:reexport')), a as (select distinct to_ref as seed, source_path as path, 1 as depth from d where source_path <> to_ref),
b as (select distinct a.seed, d.source_path as path, 2 as depth from a join d on d.to_ref = a.path where d.source_path <> a.seed) select * from a union all select b.* from b anti join a using (seed, path)""",
    "h7_dependents": f"""with {_E}, q as (select to_ref as seed from e group by 1 having count(*) >= 5), a as (select distinct seed, source_path as path, 1 as depth from q join e on e.to_ref = seed where source_path <> seed),
b as (select distinct a.seed, e.source_path as path, 2 as depth from a join e on e.to_ref = a.path where e.source_path <> a.seed),
r as (select * from a union all select b.* from b anti join a using (seed, path)),
m as (select distinct b.seed from b join e on e.to_ref = b.path anti join r on r.seed = b.seed and r.path = e.source_path where e.source_path <> b.seed) select r.*, m.seed is not null as more from r left join m using (seed)""",
    "h10_relink_set": f"with {_E}, c as (select distinct path from files where has_syntax_errors = 1) select distinct source_path as path from e where to_ref in (select path from c) and source_path not in (select path from c)",
    "h11_pagerank": f"""with {_E}, n as (select source_path as ref from e union select to_ref from e), d as (select source_path, count(*) as d from e group by 1),
r0 as materialized (select ref, 1.0 / (select count(*) from n) as score from n), {_RANK} z as (select max(score) as top from r20) select ref, round(score / top, 6) as score from r20, z""",
    "h12_repo_map": f"""with {_E}, i as (select to_ref as path, count(distinct source_path) as importers from e group by 1),
x as (select path, importers::double as score, importers, sum(ceil((length(path) + 16) / 4)) over (order by importers desc, path)::long as used from i) select path, score, importers, used from x where used <= 1000""",
}
