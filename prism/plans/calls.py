"""Queries of facts and calls over the source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.operators import evaluation, facts, linking, workspace
from prism.plans.graphs import linked
from prism.session import cut, table


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "symbols").where("path is not null and id is not null")
    return s.select("path", "seq", "id", "name", "base_name", F.lower(F.trim("kind")).alias("kind"), "parent_id", "exported", "start_line", "end_line", "params", "alias_of").distinct()


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(facts.call_sites(table(spark, sf_dir, "file_texts"), symbols(spark, sf_dir)))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, sites = cut(symbols(spark, sf_dir)), _sites(spark, sf_dir)
    out = linking.link_calls(sites, s, linked(spark, sf_dir), facts.exports_of(table(spark, sf_dir, "file_texts")))
    return cut(linking.call_edges(sites, out, s))


def x7_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions and classes at the top of the Python texts that parse."""
    return facts.python_symbols(table(spark, sf_dir, "file_texts")).where("kind in ('function', 'class', 'method')").select("path", "id", "kind", "start_line")


def x8_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).groupBy("name", "receiver_kind", "kind").agg(F.count("*").alias("n"))


def h2_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_edges(spark, sf_dir).select("source_path", "to_ref", "kind", "confidence", F.array_join("lines", ",").alias("lines"))


def h4_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files")
    packages = workspace.package_of(f.where("path is not null").select("path").distinct(), f.where("package_root is not null").select(F.col("package_root").alias("root")))
    return linking.callers(call_edges(spark, sf_dir), symbols(spark, sf_dir), packages).select("to_ref", "source_path", "evidence", "confidence", "cross_package")


def h5_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.callees(call_edges(spark, sf_dir), symbols(spark, sf_dir)).select("source_path", "to_ref", "kind", "confidence")


def a13_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = linked(spark, sf_dir).select("kind").unionByName(call_edges(spark, sf_dir).select("kind"))
    return evaluation.link_summary(e)


def x1_python_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callables of the Python texts by the kind of their bodies."""
    n = facts.python_outlines(table(spark, sf_dir, "file_texts")).where("tag in ('function', 'method')")
    return n.groupBy(F.col("attrs")["bodyKind"].alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(F.col("attrs")["shape"]).alias("shapes"))


def x11_python_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.python_types(table(spark, sf_dir, "file_texts")).groupBy("type", "origin").agg(F.count("*").alias("n"))


def h6_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.neighbors(call_edges(spark, sf_dir), symbols(spark, sf_dir)).groupBy("ref", "direction").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (x1_python_outlines, x11_python_types, h6_neighbors, x7_python_symbols, x8_call_sites, h2_call_edges, h4_callers, h5_callees, a13_link_summary)}
ORACLE: dict[str, str] = {}
