"""Fragments of an index: which file belongs to which, proposals by folder and by imports, and what has drifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.text import directory
from prism.operators import graph
from prism.operators.workspace import folders_above


def assign(paths: DataFrame, roots: DataFrame, named: DataFrame, overrides: DataFrame, fallback: str = "root") -> DataFrame:
    """(path, fragment): an override, else a fragment that names the file, else the one with the deepest folder above it, else
    the fallback. roots: (root, fragment); named and overrides: (path, fragment). Each file goes to one fragment."""
    p = paths.select("path").where("path is not null").distinct()
    ups = p.select("path", F.explode(folders_above()).alias("root")).join(roots, "root")
    deep = ups.groupBy("path").agg(F.max_by("fragment", F.struct(F.length("root"), "fragment")).alias("_d"))
    one = lambda df, name: df.groupBy("path").agg(F.min("fragment").alias(name))
    j = p.join(one(overrides, "_o"), "path", "left").join(one(named, "_n"), "path", "left").join(deep, "path", "left")
    return j.select("path", F.coalesce("_o", "_n", "_d", F.lit(fallback)).alias("fragment"))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "fragment").otherwise(s)


def told_apart(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` with an ``id``: the slug of the name, with -2, -3, .. behind it for later ones of the same slug."""
    n = F.row_number().over(Window.partitionBy(slug(F.col(name))).orderBy(order))
    return rows.withColumn("id", F.when(n == 1, slug(F.col(name))).otherwise(F.concat_ws("-", slug(F.col(name)), n.cast("string"))))


def by_folder(paths: DataFrame, package_roots: DataFrame) -> DataFrame:
    """(id, root): the fragments that the layout gives: one a package with files, else one a top folder that neither is nor
    holds a package. A package's id is its folder's name, or its whole path where two packages share the name."""
    p = paths.select("path").distinct()
    have = p.select("path", F.explode(folders_above()).alias("root")).join(package_roots.select("root").where("root <> ''").distinct(), "root", "left_semi")
    roots = have.select("root").distinct().withColumn("base", F.substring_index("root", "/", -1))
    roots = roots.withColumn("name", F.when(F.count("*").over(Window.partitionBy("base")) > 1, F.col("root")).otherwise(F.col("base"))).select("root", "name", F.lit(0).alias("o"))
    top = F.substring_index("path", "/", 1)
    free = p.join(have.select("path").distinct(), "path", "left_anti").where(F.instr("path", "/") > 0).select(top.alias("root")).distinct()
    free = free.join(roots.select(F.substring_index("root", "/", 1).alias("root")).distinct(), "root", "left_anti").select("root", F.col("root").alias("name"), F.lit(1).alias("o"))
    return told_apart(roots.unionByName(free).withColumn("place", F.concat_ws("/", F.col("o").cast("string"), "root")), "name", "place").select("id", "root")


def dominant_directory(members: DataFrame) -> DataFrame:
    """(group, folder): the deepest folder that holds at least half of a group's files; of equals the one that holds more, then
    the lesser name; "" where there is none. members: (group, path)."""
    sized = members.groupBy("group").agg(F.count("*").alias("files"))
    ups = members.select("group", F.explode(F.filter(folders_above(), lambda d: d != "")).alias("folder")).groupBy("group", "folder").agg(F.count("*").alias("n"))
    ok = ups.join(sized, "group").where(F.col("n") * 2 >= F.col("files"))
    best = ok.groupBy("group").agg(F.min(F.struct((-F.size(F.split("folder", "/"))).alias("d"), (-F.col("n")).alias("m"), "folder"))["folder"].alias("folder"))
    return sized.join(best, "group", "left").select("group", F.coalesce("folder", F.lit("")).alias("folder"))


def by_imports(paths: DataFrame, imports: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(path, fragment): communities of the import graph, named by the folder that most of each lives in. A file without imports
    goes with most of its folder's files (ties by the lesser id), or to root where none of them is in one. imports: (source_path, to_ref)."""
    p = paths.select("path").distinct()
    known = lambda c: F.col(c).isNotNull()
    e = imports.where(known("source_path") & known("to_ref") & (F.col("source_path") != F.col("to_ref"))).join(p.select(F.col("path").alias("source_path")), "source_path", "left_semi").join(p.select(F.col("path").alias("to_ref")), "to_ref", "left_semi")
    e = e.select(F.least("source_path", "to_ref").alias("a"), F.greatest("source_path", "to_ref").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    member = graph.communities(e, resolution).select(F.col("node").alias("path"), F.col("community").alias("group"))
    folder = dominant_directory(member)
    named = told_apart(folder.withColumn("label", F.when(F.col("folder") == "", "top").otherwise(F.col("folder"))), "label", "group").select("group", "id")
    own = member.join(named, "group").select("path", F.col("id").alias("fragment"))
    tally = own.groupBy(directory(F.col("path")).alias("d"), "fragment").agg(F.count("*").alias("n")).groupBy("d").agg(F.min(F.struct((-F.col("n")).alias("n"), "fragment"))["fragment"].alias("fragment"))
    rest = p.join(own.select("path"), "path", "left_anti").withColumn("d", directory(F.col("path"))).join(tally, "d", "left").select("path", F.coalesce("fragment", F.lit("root")).alias("fragment"))
    return own.unionByName(rest)


def drift(assigned: DataFrame, actual: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, actual, assigned) of files that lie in another shard than they belong to, (shard) of shards that no fragment names).
    assigned and actual: (path, fragment); fragments: (id)."""
    j = actual.select("path", F.col("fragment").alias("actual")).join(assigned.select("path", F.col("fragment").alias("assigned")), "path").where("actual <> assigned")
    orphans = actual.select(F.col("fragment").alias("shard")).distinct().join(fragments.select(F.col("id").alias("shard")), "shard", "left_anti")
    return j, orphans
