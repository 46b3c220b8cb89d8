"""Index maintenance: decisions, pruning, statistics, clones, differences, movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACY_MS = 2000


def current_files(files: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The row of each path seen last; unread rows (without digest) do not count."""
    rows = files.where("content_hash is not null and path is not null")
    if as_of is not None:
        rows = rows.where(F.col("loaded_at") <= as_of)
    cols = [c for c in files.columns if c != "path"]
    return rows.groupBy("path").agg(F.max(F.struct("seen_at", "loaded_at", *[c for c in cols if c not in ("seen_at", "loaded_at")])).alias("m")).select("path", *[F.col(f"m.{c}").alias(c) for c in cols])


def decide(now: DataFrame, before: DataFrame, last_start_ms: float) -> DataFrame:
    """(path, action): unchanged, touch, extract or remove.

    A stamp is trusted only if size and time are the same and the time lies more than two seconds before the last run's
    start; otherwise the digest decides. Paths no longer offered are removed.
    """
    a, b = now.alias("a"), before.alias("b")
    j = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    stamp = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime_ms") == F.col("b.mtime_ms")) & (F.col("a.mtime_ms") < last_start_ms - RACY_MS)
    action = (
        F.when(F.col("a.path").isNull(), "remove").when(F.col("b.path").isNull(), "extract").when(F.coalesce(stamp, F.lit(False)), "unchanged")
        .when(F.col("a.content_hash") == F.col("b.content_hash"), "touch").otherwise("extract")
    )
    return j.select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def minified(path: Column, content: Column, size: Column) -> Column:
    """Whether a file is a minified bundle or generated, by its name, its longest and its average line."""
    p = F.lower(F.translate(path, "\\", "/"))
    sample = F.substring(content, 1, 50000)  # the rule is defined on this many characters
    lines = F.split(F.translate(sample, "\r", ""), "\n")
    longest = F.array_max(F.transform(lines, F.length))
    average = F.length(sample) / F.size(lines)
    # Names of minified files, folders of assets, marks of bundles.
    named = p.rlike(r"\.min\.(?:js|mjs|cjs|css)$")
    asset = p.rlike(r"/public/js/|/public/dist/|/public/assets/|/dist/js/|/dist/assets/|/build/static/|/assets/js/")
    bundle = F.lit(False)
    for mark in ("webpackChunk", "__webpack_require__", "/*! For license information please see", "/* webpackChunkName", "parcelRequire", "System.register("):
        bundle = bundle | sample.contains(mark)
    return (
        F.when(named & (size > 512), True).when(F.length(content) < 1536, False).when((longest > 1000) & (asset | bundle), True).when(longest > 10000, True)
        .when((average > 500) & (F.size(lines) <= 15), True).when((longest > 2000) & (average > 200), True).otherwise(False)
    )


def clone_groups(rows: DataFrame, key: str, size: str, order: list[str]) -> DataFrame:
    """(key, copies, size, first): rows that share a key, at least two; size and first (by the first column of ``order``) are
    those of the first member. Members are rows, not a list: see clone_members. In their order: clone_order."""
    at = F.struct(*order, size)
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), F.min(at).alias("m")).where("copies > 1")
    return g.select(key, "copies", F.col(f"m.{size}").alias("size"), F.col(f"m.{order[0]}").alias("first"))


def clone_members(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The rows that are members of a group."""
    return rows.join(groups.select(key), key, "left_semi")


def clone_order(key: str) -> list[Column]:
    return [F.desc("size"), F.desc("copies"), F.asc(key)]


def difference(before: DataFrame, after: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """(key, n, change): the nth row of a key pairs with the nth of the other side; added, removed, modified or unchanged."""
    num = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    mark = F.xxhash64(*value)
    a, b = num(before).select(*key, "n", mark.alias("x")), num(after).select(*key, "n", mark.alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified").otherwise("unchanged")
    return a.join(b, [*key, "n"], "full_outer").select(*key, "n", change.alias("change"))


def decayed(events: DataFrame, key: str, ts: str, now: Column, half_life_days: float = 14.0) -> DataFrame:
    """(key, score, runs): a count that halves every half life."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp"))) / (86_400_000_000.0 * half_life_days)
    return events.groupBy(key).agg(F.sum(F.pow(F.lit(2.0), -age)).alias("score"), F.count("*").alias("runs"))


def movements(runs: DataFrame, key: str, at: str, value: str, window: int = 3, relative: float = 0.25, floor: float = 0.0) -> DataFrame:
    """(key, at, value, mean, moved): each value against the mean of up to ``window`` earlier ones."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(-window, -1)
    mean = F.avg(value).over(w)
    r = runs.withColumn("mean", mean)
    gap = F.col(value) - F.col("mean")
    allowed = F.greatest(F.abs("mean") * relative, F.lit(floor))
    moved = F.when(F.col("mean").isNull(), "new").when(gap > allowed, "up").when(gap < -allowed, "down").otherwise("same")
    return r.select(key, at, value, "mean", moved.alias("moved"))


def mode_first(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group; of equals, the one seen first."""
    c = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("_f"))
    return c.groupBy(group).agg(F.max(F.struct("n", (-F.col("_f")).alias("_o"), value)).alias("m")).select(group, F.col(f"m.{value}").alias(value), "m.n")
