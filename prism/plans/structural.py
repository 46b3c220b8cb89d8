"""Queries over outlines, symbols and names, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prism.functions import text as tx
from prism.operators import maintenance, outline
from prism.session import table

_NODES = """
with recursive s as (select distinct path, id, parent_id, seq, name, lower(trim(kind)) as tag, start_line, end_line, signature, doc, exported from symbols where path is not null and id is not null),
n as (select *, row_number() over (partition by path order by start_line, end_line desc, seq, id) as pre from s),
u as (select n.*, p.pre as parent_pre from n left join n p on p.path = n.path and p.id = n.parent_id),
e as (select path, pre, max(last) as end_pre from (select a.path, a.pre, b.pre as last from u a join u b on a.path = b.path and b.start_line between a.start_line and a.end_line union all select path, pre, pre from u) group by 1, 2),
nodes as (select u.*, greatest(e.end_pre, u.pre) as end_pre from u join e using (path, pre))
"""
_OUT = "path, pre, tag, name"


def _found(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return outline.select(outline.nodes(table(spark, sf_dir, "symbols")), query).select("path", "pre", "tag", "name")


def j1_child_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, '//class[@exported="1"]/method[@doc]')


def j2_descendant_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, '//class//callable[@name="run" or @name^="read"]')


def path_negated_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, '//fn[not(@exported="1")][contains(@signature, "string")]')


def path_regex_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with an escape, and one that as a substring would find nothing."""
    return _found(spark, sf_dir, r'//*[@name~="_\d+$" or @signature=~"^[a-z]+_.*:str$"]')


def path_contains_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring with a dot in it, bare and quoted values."""
    return _found(spark, sf_dir, "//class/*[contains(@name, '.r')][@kind=method]")


def path_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context attribute: the path of the file answers for a node that has none."""
    return _found(spark, sf_dir, '//class[@path$=".py"][@path]/method[not(@doc)]')


def structural_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.nodes(table(spark, sf_dir, "symbols")).select("path", "pre", "end_pre", "parent_pre", "tag", "name")


def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").where("base_name is not null").select("base_name").distinct()
    return s.select("base_name", F.array_join(tx.identifier_words(F.col("base_name")), " ").alias("words"))


def dotted_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").where("name is not null").select("name").distinct()
    return s.select("name", F.explode(tx.suffixes(F.col("name"))).alias("suffix"))


def symbol_card_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head line of each symbol's card: kind and name, words, container, module."""
    s = table(spark, sf_dir, "symbols").select("id", "path", "name", "base_name", "kind", "parent_id").distinct()
    parent = F.regexp_extract("parent_id", r"([^.#]+)$", 1)
    parts = [
        F.concat_ws(" ", F.lower(F.trim("kind")), "name"),
        F.array_join(tx.identifier_words(F.col("base_name")), " "),
        F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("in "), F.array_join(tx.identifier_words(parent), " "))),
        F.concat(F.lit("module "), F.array_join(tx.path_words(F.col("path")), " ")),
    ]
    return s.select("id", F.concat_ws(" — ", *parts).alias("head"))


def nth_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated names of a file numbered by position: the suffix of a second is ~2."""
    s = table(spark, sf_dir, "symbols").select("path", "name", "seq").distinct()
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("seq"))
    return s.select("path", "name", "seq", F.when(n > 1, F.concat(F.lit("~"), n.cast("string"))).otherwise("").alias("suffix"))


def signature_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").where("signature is not null").select("id", F.regexp_replace("signature", r"^[^(]*", "").alias("shape"), (F.col("end_line") - F.col("start_line") + 1).alias("span")).distinct()
    g = maintenance.clone_groups(s, "shape", "span", ["id"])
    return g


def clone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the ten largest groups of clones."""
    s = table(spark, sf_dir, "symbols").where("signature is not null").select("id", F.regexp_replace("signature", r"^[^(]*", "").alias("shape"), (F.col("end_line") - F.col("start_line") + 1).alias("span")).distinct()
    top = maintenance.clone_groups(s, "shape", "span", ["id"]).orderBy(*maintenance.clone_order("shape")).limit(10)
    return maintenance.clone_members(s, top, "shape")


def overload_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the first language version against the second: python against php names, nth with nth."""
    s = table(spark, sf_dir, "symbols").select("path", F.lower(F.trim("kind")).alias("kind"), "base_name", "seq", "params").distinct()
    a, b = s.where(F.col("path").endswith(".py")), s.where(F.col("path").endswith(".php"))
    d = maintenance.difference(a, b, ["kind", "base_name"], ["path", "seq"], ["params"])
    return d.groupBy("kind", "change").agg(F.count("*").alias("n"))


def innermost_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each path, the innermost symbol that spans the line in the middle of the file's symbols: latest start, earliest end."""
    s = table(spark, sf_dir, "symbols").select("path", "id", "start_line", "end_line").distinct()
    at = s.groupBy("path").agg(F.floor(F.max("end_line") / 2).cast("int").alias("line"))
    j = s.join(at, "path").where("line between start_line and end_line")
    best = j.groupBy("path", "line").agg(F.max(F.struct("start_line", (-F.col("end_line")).alias("e"), "id")).alias("m"))
    return best.select("path", "line", F.col("m.id").alias("id"))


def declaration_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: for every tenth line of a file, the declaration nearest above it, else the first of the file."""
    s = table(spark, sf_dir, "symbols").select("path", "id", "start_line", "seq").distinct()
    ends = s.groupBy("path").agg(F.max("start_line").alias("top"), F.min_by("id", F.struct("start_line", "seq")).alias("first"))
    lines = ends.select("path", "first", F.explode(F.sequence(F.lit(1), F.greatest("top", F.lit(1)), F.lit(10))).alias("line"))
    marks = s.select("path", F.col("start_line").alias("line"), F.lit(0).alias("o"), F.struct("start_line", "seq", "id").alias("d"), F.lit(None).cast("string").alias("first"))
    both = marks.unionByName(lines.select("path", "line", F.lit(1).alias("o"), F.lit(None).cast("struct<start_line:int,seq:int,id:string>").alias("d"), "first"))
    # one exchange and one sort a file instead of a range join
    w = Window.partitionBy("path").orderBy("line", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.max("d").over(w)).where("o = 1").select("path", "line", F.coalesce("last.id", "first").alias("id"))


QUERIES = {f.__name__: f for f in (j1_child_step, j2_descendant_step, structural_nodes, identifier_words, dotted_suffixes, symbol_card_heads, nth_of_name, signature_clones, clone_rows, overload_diff, innermost_symbol, declaration_above, path_negated_test, path_regex_test, path_contains_test, path_in_file)}

_WORDS = "array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(::|->|[_\\-.\\\\#/]+)', ' ', 'g'), '[$@%&?!]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z\\d])([A-Z])', '\\1 \\2', 'g')), '\\s+'), lambda w: w <> ''), ' ')"

ORACLE = {
    "structural_nodes": _NODES + "select path, pre, end_pre, parent_pre, tag, name from nodes",
    "j1_child_step": _NODES + f"select {_OUT} from nodes m where tag = 'method' and doc is not null and exists (select 1 from nodes c where c.path = m.path and c.pre = m.parent_pre and c.tag = 'class' and c.exported = 1)",
    "j2_descendant_step": _NODES + f"""select {_OUT} from nodes m where tag in ('function', 'method', 'constructor')
 and (name = 'run' or name like '%.run' or exists (select 1 from (select unnest(range(1, len(string_split(m.name, '.')) + 1)) as i) where array_to_string(list_slice(string_split(m.name, '.'), i, 99), '.') like 'read%'))
 and exists (select 1 from nodes c where c.path = m.path and m.pre > c.pre and m.pre <= c.end_pre and c.tag = 'class')""",
    "path_negated_test": _NODES + f"select {_OUT} from nodes where tag in ('function', 'method', 'constructor') and coalesce(exported, 0) <> 1 and contains(signature, 'string')",
    "path_regex_test": _NODES + f"select {_OUT} from nodes where regexp_matches(name, '_\\d+$') or regexp_matches(signature, '^[a-z]+_.*:str$')",
    "path_contains_test": _NODES + f"select {_OUT} from nodes m where tag = 'method' and exists (select 1 from nodes c where c.path = m.path and c.pre = m.parent_pre and c.tag = 'class') and (contains(name, '.r') or exists (select 1 from (select unnest(range(1, len(string_split(m.name, '.')) + 1)) as i) where contains(array_to_string(list_slice(string_split(m.name, '.'), i, 99), '.'), '.r')))",
    "path_in_file": _NODES + f"select {_OUT} from nodes m where tag = 'method' and doc is null and path like '%.py' and exists (select 1 from nodes c where c.path = m.path and c.pre = m.parent_pre and c.tag = 'class')",
    "identifier_words": f"select distinct base_name, {_WORDS.format('base_name')} as words from symbols where base_name is not null",
    "dotted_suffixes": "select name, array_to_string(list_slice(string_split(name, '.'), i, 99), '.') as suffix from (select name, unnest(range(1, len(string_split(name, '.')) + 1)) as i from (select distinct name from symbols where name is not null))",
    "symbol_card_heads": f"""select id, concat_ws(' — ', lower(trim(kind)) || ' ' || name, {_WORDS.format("base_name")}, case when parent_id is not null then 'in ' || {_WORDS.format("regexp_extract(parent_id, '([^.#]+)$', 1)")} end,
 'module ' || {_WORDS.format("regexp_replace(path, '(?i)\\.[a-z0-9]+$', '')")}) as head from (select distinct id, path, name, base_name, kind, parent_id from symbols)""",
    "nth_of_name": "select path, name, seq, case when n > 1 then '~' || n else '' end as suffix from (select *, row_number() over (partition by path, name order by seq) as n from (select distinct path, name, seq from symbols))",
    "signature_clones": "select shape, count(*) as copies, arg_min(span, id) as size, min(id) as first from (select distinct id, regexp_replace(signature, '^[^(]*', '') as shape, end_line - start_line + 1 as span from symbols where signature is not null) group by 1 having count(*) > 1",
    "clone_rows": "with s as (select distinct id, regexp_replace(signature, '^[^(]*', '') as shape, end_line - start_line + 1 as span from symbols where signature is not null) select * from s where shape in (select shape from s group by 1 having count(*) > 1 order by arg_min(span, id) desc, count(*) desc, shape limit 10)",
    "overload_diff": """with s as (select distinct path, lower(trim(kind)) as kind, base_name, seq, params from symbols),
a as (select kind, base_name, params, row_number() over (partition by kind, base_name order by path, seq) as n from s where path like '%.py'),
b as (select kind, base_name, params, row_number() over (partition by kind, base_name order by path, seq) as n from s where path like '%.php')
select coalesce(a.kind, b.kind) as kind, case when a.n is null then 'added' when b.n is null then 'removed' when a.params is distinct from b.params then 'modified' else 'unchanged' end as change, count(*) as n
from a full join b on a.kind = b.kind and a.base_name = b.base_name and a.n = b.n group by 1, 2""",
    "innermost_symbol": """with s as (select distinct path, id, start_line, end_line from symbols), m as (select path, (max(end_line) // 2)::int as line from s group by 1)
select path, line, id from (select s.path, line, id, row_number() over (partition by s.path order by start_line desc, end_line, id desc) as n from s join m using (path) where line between start_line and end_line) where n = 1""",
    "declaration_above": """with s as (select distinct path, id, start_line, seq from symbols), e as (select path, greatest(max(start_line), 1) as top, arg_min(id, (start_line, seq)) as first from s group by 1),
l as (select path, first, unnest(range(1, top + 1, 10))::int as line from e)
select l.path, l.line, coalesce((select arg_max(id, (start_line, seq, id)) from s where s.path = l.path and s.start_line <= l.line), l.first) as id from l""",
}
