"""All queries of the core, by name, with the SQL that DuckDB checks them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prism.plans import calls, card_texts, graphs, increments, indexing, patterns_and_rules, retrieval, searches, structural, upkeep

_MODULES = (increments, structural, retrieval, searches, card_texts, graphs, calls, indexing, patterns_and_rules, upkeep)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structural path query: exported classes' documented methods."""
    return QUERIES["j1_child_step"](spark, sf_dir)
