"""Telemetry: even samples that merge, batches at most once a day, and fields that nothing but what is allowed passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Events of a batch, how long it waits, what a token looks like, the types of events.
SAMPLE, INTERVAL_MS, TOKEN = 150, 86_400_000, r"^[A-Za-z0-9_.:+<>-]{1,64}$"
TYPES = ("cli_command", "search", "graph", "index", "grammar_extract", "mcp_tool_call", "rank", "error")


def even_sample(events: DataFrame, id_: str, k: int = SAMPLE, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """k events (of each group), every one as likely as any other: those of the least hashes. The sample of a union is the sample of
    the samples, so it can be kept from batch to batch (see keep_sample), and repeating a batch changes nothing."""
    order = [F.xxhash64(F.lit(seed), id_), F.col(id_)]
    if not by:
        return events.orderBy(*order).limit(k)
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def keep_sample(kept: DataFrame, batch: DataFrame, id_: str, k: int = SAMPLE, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """The sample after one more batch; events that were seen before count once."""
    return even_sample(kept.unionByName(batch).dropDuplicates([id_]), id_, k, by, seed)


def due(last: int | None, now: int, every: int = INTERVAL_MS) -> bool:
    """Whether a batch may go: none went yet, the last is long enough ago, or the clock was moved back behind it."""
    return last is None or now - last >= every or now < last


def emitted(events: DataFrame, key: str, ts: str, every: int = INTERVAL_MS) -> DataFrame:
    """(key, at, events): the batches that each key sends: at an event, if one is due, with all events since the last. On a stream the
    last batch is the state of the key; on a table the sorted events stream past, nothing of a key being gathered."""
    rows = events.select(F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("t")).where("key is not null and t is not null")
    kind = events.schema[key].dataType.simpleString()

    def fold(times: list[int], last: int | None, waiting: int) -> tuple[list[tuple[int, int]], int | None, int]:
        out = []
        for t in times:
            waiting += 1
            if due(last, t, every):
                out.append((t, waiting))
                last, waiting = t, 0
        return out, last, waiting

    if events.isStreaming:

        def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            last, waiting = state.get if state.exists else (None, 0)
            out, last, waiting = fold(sorted(t for f in frames for t in f["t"].tolist()), last, waiting)
            state.update((last, waiting))
            yield pd.DataFrame([(k[0], *o) for o in out], columns=["key", "at", "events"])

        return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at long, events long", "last long, waiting long", "append", GroupStateTimeout.NoTimeout)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, waiting = None, None, 0
        for f in frames:  # a key may go over several batches: what is kept of it is two numbers
            rows = []
            for k, part in f.groupby("key", sort=False):
                if k != own:
                    own, last, waiting = k, None, 0
                out, last, waiting = fold(part["t"].tolist(), last, waiting)
                rows += [(k, *o) for o in out]
            yield pd.DataFrame(rows, columns=["key", "at", "events"])

    return rows.repartition("key").sortWithinPartitions("key", "t").mapInPandas(run, f"key {kind}, at long, events long")


def scrubbed(events: DataFrame, fields: dict[str, str | float], source: str = "props") -> DataFrame:
    """``events`` with a column for each allowed field of a JSON object, null where the value is not what the field may be: ``token`` (a short
    name), ``flag`` (true or false), or a number from 0 to the one given. All else is dropped with the object."""
    out = events
    for name, rule in fields.items():
        raw = F.get_json_object(source, f"$.{name}")
        # the kind of a value is that of its JSON text: a quoted number is no number
        text = F.regexp_extract(F.get_json_object(F.to_json(F.struct(F.col(source).alias("s"))), "$.s"), rf'"{name}"\s*:\s*("?)', 1)
        if rule == "token":
            value = F.when((text == '"') & raw.rlike(TOKEN), raw)
        elif rule == "flag":
            value = F.when((text != '"') & raw.isin("true", "false"), raw.cast("boolean"))
        else:
            n = F.when((text != '"') & raw.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), raw.cast("double"))
            value = F.when((n >= 0) & (n <= float(rule)), n)
        out = out.withColumn(name, value)
    return out.drop(source)


def recent(use: DataFrame, least: float = 0.05) -> DataFrame:
    """What is still in use: a decayed score of at least 0.05."""
    return use.where(F.col("score") >= least)
