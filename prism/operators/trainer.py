"""Mappings learned from syntax: how node types are built, what each becomes, how it extends a base, and whether it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in the names of node types and what they say, in the order they are tried.
KINDS = (
    ("method", "method"), (r"(^|_)(function|func|fn|procedure|subroutine|constructor)($|_)", "function"), ("interface|protocol", "interface"), ("trait", "trait"), ("enum", "enum"), ("struct|record|union", "struct"),
    ("class|object_declaration|object_definition", "class"), (r"(^|_)(type_alias|type_spec|type_item|type_declaration|type_definition|typedef)($|_)", "type"), (r"(^|_)(namespace|mod|module|package)($|_)", "module"), (r"(^|_)(const|constant)($|_)", "constant"),
)
CONTROL = ("if", "for", "while", "switch", "match", "try", "catch", "except", "with", "return", "yield", "throw", "raise", "assert")
NOT_DECLARED = r"parameter|argument|(^|_)pair($|_)|property_identifier|(^|_)enumerator$|(^|_)member(_|$)|^preproc_|_(expression|literal|variant|constant|clause)$"
ANONYMOUS = r"lambda|arrow|closure|anonymous_function|function_expression|func_literal"
HOLDER = r"class|struct|impl|trait|interface|object|record|enum"
IMPORTED = r"(^|_)(import|use|include|require|using)($|_)"
BODIES, PARAMETERS = ("body", "block", "members", "declaration_list", "field_declaration_list"), r"(?i)param"
CALLED, ARGUMENTS = ("function", "callee", "method", "receiver", "object"), ("argument", "arguments")
MIN_SHARE, MIN_SEEN = 0.5, 3


def topology(nodes: DataFrame) -> DataFrame:
    """(type, count, files, parents, ancestors, fields) of each node type: how often, in how many files, and how often within what.

    nodes: (path, pre, end_pre, parent_pre, type, field), field being the one of its parent that a node fills, if any. fields counts
    the nodes of a type that have such a child; ancestors those that have such an ancestor, once each."""
    n = nodes.select("path", "pre", "end_pre", "parent_pre", "type", "field")
    base = n.groupBy("type").agg(F.count("*").alias("count"), F.countDistinct("path").alias("files"))
    up = n.select("path", F.col("pre").alias("parent_pre"), F.col("type").alias("p"))
    tally = lambda df, name: df.groupBy("type", "k").agg(F.count("*").alias("n")).groupBy("type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    parents = tally(n.join(up, ["path", "parent_pre"]).select("type", F.col("p").alias("k")), "parents")
    above = n.select("path", F.col("pre").alias("a_pre"), F.col("end_pre").alias("a_end"), F.col("type").alias("k"))
    ancestors = tally(n.join(above, "path").where("pre > a_pre and pre <= a_end").select("type", "path", "pre", "k").distinct(), "ancestors")
    kids = n.where("field is not null").select("path", F.col("parent_pre").alias("pre"), F.col("field").alias("k")).distinct()
    fields = tally(n.join(kids, ["path", "pre"]).select("type", "k"), "fields")
    none = lambda c: F.coalesce(c, F.create_map().cast("map<string,long>"))
    return base.join(parents, "type", "left").join(ancestors, "type", "left").join(fields, "type", "left").select("type", "count", "files", *[none(F.col(c)).alias(c) for c in ("parents", "ancestors", "fields")])


def commonest(counts: Column) -> Column:
    """The key of the greatest count; of equals the least."""
    return F.array_min(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))["k"]


def deduce(types: DataFrame, share: float = MIN_SHARE) -> DataFrame:
    """(type, tag, role, count): what each node type of a topology becomes, in this order: a call, control flow, an import, a declaration,
    a callable without a name. A function that is always within a holder of members is a method. Clauses of a construct
    that has the same tag, and parts of imports, are left out, as is what nothing is known of."""
    t = types.where(~F.col("type").startswith("_") & (F.col("type") != "ERROR"))
    has = lambda names: reduce(lambda a, b: a | b, [F.map_contains_key("fields", n) for n in names])
    body, params = has(BODIES), F.exists(F.map_keys("fields"), lambda f: f.rlike(PARAMETERS))
    named = F.coalesce(F.try_element_at("fields", F.lit("name")), F.lit(0)) / F.col("count") >= share
    kind = reduce(lambda acc, k: F.when(F.col("type").rlike(k[0]), k[1]).otherwise(acc), reversed(KINDS), F.lit(None).cast("string"))
    control = F.lit(None).cast("string")
    for word in reversed(CONTROL):
        form = r"_statement$" if word == "try" else rf"_(statement|expression|clause)$|^{word}$"
        control = F.when(F.col("type").rlike(rf"(^|_){word}($|_)"), F.when(F.col("type").rlike(form), word)).otherwise(control)
    call = ~body & has(ARGUMENTS) & (has(CALLED) | (has(("name",)) & F.col("type").rlike("call|invocation|apply")))
    part = F.coalesce(commonest(F.col("parents")).rlike(IMPORTED), F.lit(False))
    held = F.coalesce(F.array_max(F.transform(F.filter(F.map_entries("ancestors"), lambda e: e["key"].rlike(HOLDER)), lambda e: e["value"])), F.lit(0)) == F.col("count")
    declared = named & (body | kind.isNotNull()) & ~F.col("type").rlike(NOT_DECLARED)
    bare = body & params & ~named & F.col("type").rlike(ANONYMOUS)
    role = F.when(call, "call").when(control.isNotNull(), "control-flow").when(F.col("type").rlike(IMPORTED), F.when(~part, "import")).when(declared, "declaration").when(bare, "anonymous-callable")
    own = F.coalesce(kind, F.col("type"))
    tag = (
        F.when(role == "call", "call").when(role == "control-flow", control).when(role == "import", "import").when(role == "declaration", F.when((own == "function") & held, "method").otherwise(own))
        .when(role == "anonymous-callable", F.when(F.col("type").contains("arrow"), "arrow").when(F.col("type").contains("closure"), "closure").otherwise("lambda"))
    )
    d = t.select("type", tag.alias("tag"), role.alias("role"), "count", "files", commonest(F.col("parents")).alias("parent")).where("role is not null")
    outer = d.select(F.col("type").alias("parent"), F.col("tag").alias("p_tag"))
    return d.join(outer, "parent", "left").where(~F.coalesce((F.col("role") == "control-flow") & (F.col("p_tag") == F.col("tag")), F.lit(False))).select("type", "tag", "role", "count", "files", "parent")


def extend(base: DataFrame, learned: DataFrame, least: int = MIN_SEEN, least_files: int = 1) -> DataFrame:
    """(type, tag, how, reason): the base (type, tag) with what was learned beside it: base, added, or skipped where the type usually sits in
    something that the base maps, or was seen too seldom."""
    new = learned.join(base.select("type"), "type", "left_anti").join(base.select(F.col("type").alias("parent"), F.col("tag").alias("p_tag")), "parent", "left")
    rare = (F.col("count") < least) | (F.col("files") < least_files)
    reason = F.when(F.col("p_tag").isNotNull(), F.concat(F.lit("it sits in "), "parent")).when(rare, F.lit("seen too seldom"))
    return base.select("type", "tag", F.lit("base").alias("how"), F.lit(None).cast("string").alias("reason")).unionByName(new.select("type", "tag", F.when(reason.isNull(), "added").otherwise("skipped").alias("how"), reason.alias("reason")))


def with_tag_rules(learned: DataFrame, rules: DataFrame) -> DataFrame:
    """What was learned with the rules (type, tag) of a grammar's own query laid over it."""
    r = rules.groupBy("type").agg(F.min("tag").alias("_r"))
    return learned.join(r, "type", "left").withColumn("tag", F.coalesce("_r", "tag")).drop("_r")


def verify(mapping: DataFrame, types: DataFrame, outline: DataFrame) -> DataFrame:
    """(tag, expected, found): how many nodes should become a tag by the mapping, and how many of the outline (tag) did."""
    want = mapping.join(types.select("type", "count"), "type", "left").groupBy("tag").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("expected"))
    got = outline.groupBy("tag").agg(F.count("*").alias("found"))
    return want.join(got, "tag", "left").select("tag", "expected", F.coalesce("found", F.lit(0)).alias("found"))


def audit(types: DataFrame, mapping: DataFrame, learned: DataFrame) -> DataFrame:
    """(type, count, candidate): the node types that a mapping does not map, most frequent first, with the tag that was learned for each."""
    open_ = types.where(~F.col("type").startswith("_") & (F.col("type") != "ERROR")).join(mapping.select("type"), "type", "left_anti")
    return open_.join(learned.select("type", F.col("tag").alias("candidate")), "type", "left").select("type", "count", "candidate").orderBy(F.desc("count"), "type")


def golden_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tag, name, before, after) of the records of an outline that stand another number of times than in the record kept."""
    a, b = (x.groupBy("tag", "name").agg(F.count("*").alias(n)) for x, n in ((before, "before"), (after, "after")))
    j = a.join(b, ["tag", "name"], "full_outer").fillna(0, ["before", "after"])
    return j.where("before <> after")
