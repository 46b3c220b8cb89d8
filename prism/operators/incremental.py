"""Incremental processing with the target as the only state.

Each published version of the target holds, for every source key touched by the run, the key, its version
(digest) and the stamp that decided it. A run reads only source rows loaded since the previous published
run, keeps the last seen row of each key, anti-joins it against the target, writes the rest to a folder of its
own and publishes it by one small file in the log, which names that folder. The file gets its number by an operation
that fails where the number is taken, so of two runs that race for it one is told to begin again and neither is lost.
A run that dies before that leaves nothing that a reader would see, so repeating it neither skips nor repeats a record.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_COLUMNS = ("key", "version", "stamp", "changed", "run_id", "run_no")


def normal_digest(c: Column | str) -> Column:
    """A digest however spelled: letter case, blanks and an algorithm prefix aside; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9_-]*[:=]|0x)", "")
    bare = F.regexp_replace(bare, r"[^0-9a-z+/=]", "")
    return F.when(F.length(bare) > 0, bare)


class Overtaken(RuntimeError):
    """Another run published the version that this one was about to publish; it can be repeated at once."""


def land(source: DataFrame, root: str, key: str, version: Column, seen: str, loaded: str) -> DataFrame:
    """The source cut to key, version, seen and loaded, written by day of loading, so that a run reads only the days that are
    new to it. Rows that count as not observed (see IncrementalTarget) stay out. Large days are split and small ones put
    together by their size (rebalance), not by the number of days."""
    rows = source.select(F.col(key).alias("key"), version.alias("version"), F.col(seen).alias("seen"), F.col(loaded).alias("loaded"))
    rows = rows.where("key is not null and version is not null and seen is not null and loaded is not null").withColumn("day", F.to_date("loaded"))
    path = f"{root.rstrip('/')}/landed-{uuid.uuid4().hex}"
    rows.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    return source.sparkSession.read.schema(rows.schema).parquet(path)


class IncrementalTarget:
    """Versions of a target under ``root``, each published atomically.

    Null keys, versions, seen or loaded times: the row counts as not observed. Repeated rows: one row.
    Ties in the seen time: the later loaded, then the greater version wins. An empty source publishes an
    empty version. Extra columns of the source are ignored.

    A version is a file ``log/<number>.json`` that names a folder under ``data``. On a local disk the file is put in place by
    a hard link, elsewhere by a rename that may not overwrite; both fail where the number is taken. On an object store the
    rename must be atomic (as the conditional write of its connector makes it); folders are never renamed.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 8):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every
        self._jvm = spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[dict]:
        """Metadata of the published versions, oldest first; unfinished ones are invisible."""
        log = self._path(f"{self.root}/log")
        if not self._fs.exists(log):
            return []
        found = []
        for status in self._fs.listStatus(log):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                stream = self._fs.open(status.getPath())
                try:
                    found.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return sorted(found, key=lambda m: m["run_no"])

    def _publish(self, meta: dict, folder: str) -> None:
        """Put the log file of a version in place, or raise Overtaken."""
        staged, final = self._path(f"{folder}/meta.json"), self._path(f"{self.root}/log/{meta['run_no']:09d}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        taken = Overtaken(f"version {meta['run_no']} was published by another run")
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(staged.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                raise taken from None
            return
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(staged, final, how)
        except Exception as e:
            if self._fs.exists(staged):
                raise taken from e
            raise

    def clean(self, older_than_hours: float = 24.0) -> int:
        """Delete folders that no version names and that are older than a run may take; how many."""
        named, data, gone = {m["folder"] for m in self.versions()}, self._path(f"{self.root}/data"), 0
        if self._fs.exists(data):
            limit = datetime.now().timestamp() * 1000 - older_than_hours * 3_600_000
            for status in self._fs.listStatus(data):
                if status.getPath().getName() not in named and status.getModificationTime() < limit:
                    gone += bool(self._fs.delete(status.getPath(), True))
        return gone

    def _dir(self, meta: dict) -> str:
        return f"{self.root}/data/{meta['folder']}"

    def state(self) -> DataFrame | None:
        """The newest published (key, version, stamp) of every key, from the last compacted version on."""
        published = self.versions()
        if not published:
            return None
        base = max((i for i, m in enumerate(published) if m["compacted"]), default=None)
        parts = [f"{self._dir(m)}/delta" for m in published[0 if base is None else base + 1 :]]
        if base is not None:
            parts.append(f"{self._dir(published[base])}/state")
        rows = self.spark.read.parquet(*parts).select("key", "version", "stamp")
        if len(parts) == 1:
            return rows
        return rows.groupBy("key").agg(F.max_by("version", "stamp").alias("version"), F.max("stamp").alias("stamp"))

    def changes(self) -> DataFrame | None:
        """All published changes: run_id, key, version."""
        published = self.versions()
        if not published:
            return None
        rows = self.spark.read.parquet(*[f"{self._dir(m)}/delta" for m in published])
        return rows.where("changed").select("run_id", "key", "version")

    def process(self, source: DataFrame, run_id: int, as_of: datetime, key: str = "key", version: Column | None = None, seen: str = "seen", loaded: str = "loaded") -> bool:
        """Publish what is new in ``source`` as of ``as_of``. False: that run was published before. Overtaken: begin again.

        A source that was landed (it has the column ``day``) is read only from the day of the last published run on."""
        published = self.versions()
        if any(m["run_id"] == run_id for m in published):
            return False
        since = datetime.fromisoformat(published[-1]["as_of"]) if published else None
        if since and as_of < since:
            raise ValueError("runs must be processed in the order of their start")
        until = F.lit(as_of)
        slice_ = source.where(F.col(loaded) <= until)
        if "day" in source.columns:
            slice_ = slice_.where(F.col("day") <= F.to_date(until))
        if since:
            slice_ = slice_.where(F.col(loaded) > F.lit(since))
            if "day" in source.columns:
                slice_ = slice_.where(F.col("day") >= F.to_date(F.lit(since)))
        latest = (
            slice_.select(F.col(key).alias("key"), (F.col("version") if version is None else version).alias("version"), F.col(seen).alias("_s"), F.col(loaded).alias("_l"))
            .where("key is not null and version is not null and _s is not null")
            .groupBy("key")
            .agg(F.max(F.struct("_s", "_l", "version")).alias("stamp"))
            .select("key", F.col("stamp.version").alias("version"), "stamp")
        )
        state = self.state()
        if state is None:
            delta = latest.withColumn("changed", F.lit(True))
        else:
            # one left join serves both: what is older than the target falls out, what has the same version is not a change
            old = state.select("key", F.col("version").alias("_v"), F.col("stamp").alias("_st"))
            delta = latest.join(old, "key", "left").where("_st is null or _st < stamp").select("key", "version", "stamp", F.coalesce(F.col("_v") != F.col("version"), F.lit(True)).alias("changed"))
        no, folder = len(published) + 1, uuid.uuid4().hex
        staged = f"{self.root}/data/{folder}"
        delta.withColumn("run_id", F.lit(run_id)).withColumn("run_no", F.lit(no)).select(*STATE_COLUMNS).write.parquet(f"{staged}/delta")
        compacted = no % self.compact_every == 0 and state is not None
        if compacted:
            fresh = self.spark.read.parquet(f"{staged}/delta").select("key", "version", "stamp")
            both = state.unionByName(fresh).groupBy("key").agg(F.max_by("version", "stamp").alias("version"), F.max("stamp").alias("stamp"))
            both.write.parquet(f"{staged}/state")
        self._publish({"run_id": run_id, "run_no": no, "as_of": as_of.isoformat(), "compacted": compacted, "folder": folder}, staged)
        return True
