"""Session helpers shared by every operator."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a fresh local one in local mode (tests), and
    an error on a cluster, whose machines do not share their disks."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="prism-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


class DeadlineError(TimeoutError):
    pass


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """What runs inside is cancelled when its time is up; jobs of other threads go on."""
    sc, group, up = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        up.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        yield
    except Exception as e:
        if up.is_set():
            raise DeadlineError(f"not done after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


class ConfigError(ValueError):
    pass


# What a project's configuration may hold and how each value is checked.
_NUMBER = (lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0, "a number of at least 0")
_NAMES = (lambda v: isinstance(v, list) and all(isinstance(x, str) and x for x in v), "a list of names")
CONFIG = {
    "fusionK": _NUMBER, "include": _NAMES, "exclude": _NAMES, "languages": _NAMES, "channels": (lambda v: isinstance(v, dict), "an object by channel"), "search": (lambda v: isinstance(v, dict), "an object"),
    "channels.*.weight": _NUMBER, "channels.*.enabled": (lambda v: isinstance(v, bool), "true or false"), "search.minScore": _NUMBER, "search.excludeLanes": _NAMES,
}


def read_config(text: str) -> dict:
    """A project's configuration, every field of it checked; unknown fields are errors that name themselves."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"not valid JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigError("must be an object")

    def check(at: str, rule: str, value: object) -> None:
        if rule not in CONFIG:
            raise ConfigError(f"{at} is not a known field")
        ok, what = CONFIG[rule]
        if not ok(value):
            raise ConfigError(f"{at} must be {what}")

    for k, v in raw.items():
        check(k, k, v)
        for name, inner in v.items() if k in ("channels", "search") else ():
            if k == "search":
                check(f"search.{name}", f"search.{name}", inner)
                continue
            if not isinstance(inner, dict):
                raise ConfigError(f"channels.{name} must be an object")
            for f, x in inner.items():
                check(f"channels.{name}.{f}", f"channels.*.{f}", x)
    return raw
