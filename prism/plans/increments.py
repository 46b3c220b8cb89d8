"""Problem 3: what each succeeded run must process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prism.operators.incremental import IncrementalTarget, land, normal_digest
from prism.session import table, work_dir


def replay(spark: SparkSession, runs: DataFrame, files: DataFrame, root: str) -> IncrementalTarget:
    """Carry out the history of runs against a fresh target; runs that did not succeed publish nothing.

    The source is landed by day of loading once, so that each run reads the days new to it. The history is one row a
    run, read in the order of the starts; no row of the source reaches the driver.
    """
    landed = land(files, root, "path", normal_digest("content_hash"), "seen_at", "loaded_at")
    target = IncrementalTarget(spark, root)
    done = runs.where((F.lower(F.trim("status")) == "succeeded") & F.col("started_at").isNotNull())
    history = done.groupBy("run_id").agg(F.min("started_at").alias("at")).orderBy("at", "run_id")
    for r in history.toLocalIterator():
        target.process(landed, r["run_id"], r["at"])
    return target


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, path): the paths whose content is new since the succeeded run before."""
    target = replay(spark, table(spark, sf_dir, "runs"), table(spark, sf_dir, "files"), work_dir(spark, "p3"))
    found = target.changes()
    if found is None:
        return spark.createDataFrame([], "run_id int, path string")
    return found.select("run_id", F.col("key").alias("path"))


QUERIES = {"p3_found": p3_found}

ORACLE = {
    "p3_found": """
with ok as (select run_id, started_at, row_number() over (order by started_at, run_id) as n
            from (select distinct run_id, started_at from runs where status = 'succeeded')),
src as (select path, regexp_replace(lower(trim(content_hash)), '^[a-z][a-z0-9_-]*[:=]', '') as digest, seen_at, loaded_at
        from files where content_hash is not null and trim(content_hash) <> ''),
cur as (select n, run_id, path, arg_max(digest, (seen_at, loaded_at, digest)) as digest
        from ok join src on src.loaded_at <= ok.started_at group by all)
select a.run_id, a.path from cur a left join cur b on b.path = a.path and b.n = a.n - 1
where b.path is null or a.digest <> b.digest
"""
}
