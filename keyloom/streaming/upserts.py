"""Logs as streams: running snapshots, commits to a store, per-key read-modify-write with expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.model import DELETED, KEY, SEQ, VALUE
from keyloom.sources.store import Store


def running_snapshot(ops: DataFrame) -> DataFrame:
    """Newest operation of each key so far; for output modes complete and update. Tombstones stay in the state, so an
    older put that comes late does not revive a key; the reader drops rows that are deleted."""
    best = ops.groupBy(KEY).agg(F.max_by(F.struct(VALUE, DELETED), SEQ).alias("row"), F.max(SEQ).alias(SEQ))
    return best.select(KEY, F.col(f"row.{VALUE}").alias(VALUE), F.col(f"row.{DELETED}").alias(DELETED), SEQ)


def into_store(ops: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is one commit of the store; an operation that comes late, with a smaller seq, undoes nothing."""

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.apply(batch)

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_put(ops: DataFrame, within: str) -> DataFrame:
    """Insert-if-absent by key on a stream with a watermark on `at`."""
    return ops.withWatermark("at", within).dropDuplicatesWithinWatermark([KEY])


def read_modify_write(ops: DataFrame, update: Callable[[int | None, dict], int], ttl_ms: int | None = None) -> DataFrame:
    """seq, key, reply: the value after each operation, by update(old or None, row) in the order of seq inside a
    micro-batch. With ttl_ms a key's value is forgotten when it wasn't touched for so long."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(SEQ)
        replies = []
        for row in rows.to_dict("records"):
            value = update(value, row)
            replies.append(value)
        state.update((value,))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({SEQ: rows[SEQ].to_numpy(), KEY: [key[0]] * len(rows), "reply": replies})

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    kind = ops.schema[KEY].dataType.simpleString()
    return ops.groupBy(KEY).applyInPandasWithState(run, f"{SEQ} long, {KEY} {kind}, reply long", "value long", "append", timeout)
