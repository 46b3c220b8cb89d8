"""The index as tables: reads, replacement of units, staleness, synchronisation, tiers and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_of(c: Column, values: list) -> Column:
    """The column is one of the values; an empty list is nothing, not everything."""
    return c.isin(*values) if values else F.lit(False)


def find_symbols(symbols: DataFrame, name: str | None = None, base_name: str | None = None, prefix: str | None = None, kinds: list[str] | None = None, path: str | None = None, exported_only: bool = False) -> DataFrame:
    """Symbols that meet all that is given. kinds=[] finds nothing; exported_only leaves out what is not or not known to be."""
    c = F.lit(True)
    for column, value in (("name", name), ("base_name", base_name), ("path", path)):
        if value is not None:
            c = c & (F.col(column) == value)
    if prefix is not None:
        c = c & F.col("name").startswith(prefix)
    if kinds is not None:
        c = c & one_of(F.lower(F.trim("kind")), kinds)
    if exported_only:
        c = c & (F.col("exported") == 1)
    return symbols.where(c)


def find_edges(edges: DataFrame, source: str | None = None, target: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Edges that meet all that is given; in their order by edge_order."""
    c = F.lit(True)
    if source is not None:
        c = c & (F.col("source_path") == source)
    if target is not None:
        c = c & (F.col("to_ref") == target)
    if kinds is not None:
        c = c & one_of(F.col("kind"), kinds)
    return edges.where(c)


def find_like(symbols: DataFrame, ending: str) -> DataFrame:
    """The looser reading of the native store: names that end with a text."""
    return symbols.where(F.col("name").endswith(ending))


def replace_units(old: DataFrame, new: DataFrame, unit: str = "path", removed: DataFrame | None = None) -> DataFrame:
    """``old`` with all rows of the units in ``new`` replaced by those of ``new``, and those of ``removed`` (unit) gone. A unit that
    ``new`` does not name keeps its rows."""
    gone = new.select(unit).distinct()
    if removed is not None:
        gone = gone.union(removed.select(unit)).distinct()
    return old.join(gone, unit, "left_anti").unionByName(new)


def touch(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """``files`` with the size and time of ``stamps`` (path, size, mtime_ms) where their content did not change."""
    s = stamps.select("path", F.col("size").alias("_s"), F.col("mtime_ms").alias("_m"))
    return files.join(s, "path", "left").withColumn("size", F.coalesce("_s", "size")).withColumn("mtime_ms", F.coalesce("_m", "mtime_ms")).drop("_s", "_m")


def with_quarantined(indexed: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Both kinds of files in one list, with the status of each."""
    return indexed.withColumn("status", F.lit("indexed")).unionByName(quarantined.withColumn("status", F.lit("quarantined")), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def edge_order() -> list[Column]:
    return [F.asc("source_path"), F.asc("seq")]


# ---- staleness


def must_rebuild(meta: dict[str, str], signatures: dict[str, str]) -> dict[str, bool]:
    """What an indexing run must do anew: everything where the last one left its mark (``dirty``), else each part whose
    signature differs from the one the index was built with."""
    dirty = meta.get("dirty") == "1"
    return {part: dirty or meta.get(f"signature.{part}") != s for part, s in signatures.items()}


class DirtyMark:
    """Set before the first write, cleared after the last; found set, the run before did not end."""

    def __init__(self, meta: dict[str, str]):
        self.meta = meta

    def __enter__(self) -> DirtyMark:
        self.meta["dirty"] = "1"
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.meta.pop("dirty", None)


def channel_sync(now: DataFrame, stored: DataFrame, version: str, model: str) -> DataFrame:
    """(path, action): unchanged where digest, version of the transformer and model are those of the store; upsert; delete where
    the source is gone. now: (path, digest); stored: (path, digest, version, model)."""
    a, b = now.alias("a"), stored.alias("b")
    same = (F.col("a.digest") == F.col("b.digest")) & (F.col("b.version") == version) & (F.col("b.model") == model)
    action = F.when(F.col("a.path").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("upsert")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def to_refresh(now: DataFrame, loaded: DataFrame) -> DataFrame:
    """(path) whose outline must be read again: its digest is not the one that is loaded."""
    return now.join(loaded.select("path", F.col("digest").alias("_d")), "path", "left").where("_d is null or _d <> digest").select("path")


def stale(results: DataFrame, now: DataFrame) -> DataFrame:
    """(path, reason) of the files of a page that are not as indexed: removed, or changed by size or time.
    results: (path, size, mtime_ms) as indexed; now: the same as listed."""
    n = now.select("path", F.col("size").alias("_s"), F.col("mtime_ms").alias("_m"))
    j = results.select("path", "size", "mtime_ms").distinct().join(n, "path", "left")
    reason = F.when(F.col("_s").isNull(), "removed").when((F.col("_s") != F.col("size")) | (F.col("_m") != F.col("mtime_ms")), "changed")
    return j.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (fingerprint): the same for the same rows in any order, a digest of sums of digests."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("x")).select(F.sha2(F.concat_ws("/", "n", F.coalesce("s", F.lit(0)), F.coalesce("x", F.lit(0))), 256).alias("fingerprint"))


# ---- tiers and shards


def shadowed(tiers: list[DataFrame], key: str) -> DataFrame:
    """The rows of several tiers, the first of which wins where they share a key (with ``tier``, from 0)."""
    rows = None
    for n, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(n))
        rows = t if rows is None else rows.unionByName(t)
    first = F.min("tier").over(Window.partitionBy(key))
    return rows.withColumn("_f", first).where("tier = _f").drop("_f")


def merged(shards: list[DataFrame]) -> DataFrame:
    """The rows of all shards as one store has them; in its order by path and place."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    return rows


def resolve_target(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, how, found, id): what each target names: an id, else path:line (the innermost symbol), else a full name, else a
    base name. found: how many symbols the first way that finds any does; id only where it is one."""
    s = symbols.select("path", "id", "name", "base_name", "start_line", "end_line").where("id is not null").distinct()
    t = targets.select("target").where("target is not null").distinct()
    line = F.regexp_extract("target", r":(\d+)$", 1)
    at = t.where(line != "").select("target", F.regexp_replace("target", r":\d+$", "").alias("path"), line.cast("int").alias("line"))
    inner = at.join(s, "path").where("line between start_line and end_line").groupBy("target").agg(F.max(F.struct("start_line", (-F.col("end_line")).alias("e"), "id")).alias("m"))
    ways = [
        t.join(s.select(F.col("id").alias("target"), "id"), "target").select("target", F.lit(0).alias("w"), F.lit("id").alias("how"), "id"),
        inner.select("target", F.lit(1).alias("w"), F.lit("line").alias("how"), F.col("m.id").alias("id")),
        t.join(s.select(F.col("name").alias("target"), "id"), "target").select("target", F.lit(2).alias("w"), F.lit("name").alias("how"), "id"),
        t.join(s.select(F.col("base_name").alias("target"), "id"), "target").select("target", F.lit(3).alias("w"), F.lit("base name").alias("how"), "id"),
    ]
    rows = merged(ways).groupBy("target", "w", "how").agg(F.countDistinct("id").alias("found"), F.min("id").alias("id"))
    best = rows.groupBy("target").agg(F.min(F.struct("w", "how", "found", "id")).alias("m"))
    return t.join(best, "target", "left").select("target", F.coalesce("m.how", F.lit("none")).alias("how"), F.coalesce("m.found", F.lit(0)).alias("found"), F.when(F.col("m.found") == 1, F.col("m.id")).alias("id"))
