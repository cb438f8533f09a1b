"""Snapshots that arrive as a stream: each batch is compared with the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.drift import diff_snapshots


def watch(tables: DataFrame, last: Callable[[], tuple[DataFrame, DataFrame] | None], split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """tables: a stream of snapshot rows; split gives a batch's tables and columns, last
    the snapshot to compare with, sink stores the changes (and the snapshot) of a batch.
    A batch that is repeated after a failure gives the same changes."""

    def step(batch: DataFrame, number: int) -> None:
        now, before = split(batch), last()
        if before is not None:
            sink(diff_snapshots(before[0], now[0], before[1], now[1]), number)

    return tables.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
