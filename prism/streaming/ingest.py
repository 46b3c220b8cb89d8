"""Streams of observed files into a versioned target: one commit a micro-batch, each batch once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prism.operators.incremental import IncrementalTarget, Overtaken


def ingest(stream: DataFrame, target: IncrementalTarget, checkpoint: str, key: str, version: Column, seen: str, every: str | None = None) -> StreamingQuery:
    """Apply a stream of observations to a target. A micro-batch is one version, published under the batch's number, so that a
    batch that is run again after a failure is not applied twice; one that is overtaken by another writer begins again. every: how
    long writes are gathered into one commit (None: what is there now, then stop)."""
    first = datetime(1970, 1, 1)

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_at", F.lit(first + timedelta(seconds=number + 1)))
        while True:
            try:
                # the batch's number is its time of loading: a version reads what was loaded since the one before
                target.process(rows, number, first + timedelta(seconds=number + 1), key, version, seen, "_at")
                return
            except Overtaken:
                continue

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
