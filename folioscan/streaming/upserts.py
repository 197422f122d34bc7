"""Continuous maintenance: micro-batches of documents are upserted into a snapshot set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.incremental import keep_ids, upsert
from folioscan.sources.tables import Snapshots


def upsert_stream(stream: DataFrame, snapshots: Snapshots, table: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Each batch replaces the rows of its keys; a batch that is run again after a failure gives the same tables."""

    def merge(batch: DataFrame, number: int) -> None:
        done = (snapshots.manifest() or {}).get("batch", -1)
        if number <= done:
            return
        now = snapshots.load()
        if table not in now:
            now[table] = batch.limit(0)
        snapshots.commit(upsert(now, {table: batch}, force=True, key=key), batch=number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delete_keys(snapshots: Snapshots, keys: DataFrame, key: str = "doc_id") -> None:
    snapshots.commit({k: keep_ids(t, keys, False, key) for k, t in snapshots.load().items()})
