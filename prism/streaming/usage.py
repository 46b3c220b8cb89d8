"""Streams of usage events: decayed counters as keyed state, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HALF_LIFE_MS = 14 * 86_400_000.0
REPEAT_MS = 120_000


def fold(score: float, last: int, runs: int, repeats: int, days: int, times: list[int]) -> tuple[float, int, int, int, int]:
    """State after events at ``times`` (ms, ascending): the score halves every half life and gains one an event; an event
    within two minutes of the one before is a repeat; a change of day counts. A clock that goes back decays nothing."""
    for t in times:
        gap = max(0, t - last) if runs else 0
        score = score * 2.0 ** (-gap / HALF_LIFE_MS) + 1.0
        repeats += bool(runs) and gap <= REPEAT_MS
        days += not runs or t // 86_400_000 > last // 86_400_000
        last, runs = max(last, t) if runs else t, runs + 1
    return score, last, runs, repeats, days


def usage(events: DataFrame, key: str = "event_type", ts: str = "ts") -> DataFrame:
    """(key, score, runs, repeats, days) after each micro-batch, by keyed state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0.0, 0, 0, 0, 0)
        times = sorted(t for f in frames for t in f["t"].tolist())
        now = fold(*now, times)
        state.update(now)
        yield pd.DataFrame({"key": [k[0]], "score": [now[0]], "runs": [now[2]], "repeats": [now[3]], "days": [now[4]]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("t")).where("key is not null and t is not null")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, score double, runs long, repeats long, days long", "score double, last long, runs long, repeats long, days long", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total): tumbling windows with a watermark; works on streams and on tables."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")
