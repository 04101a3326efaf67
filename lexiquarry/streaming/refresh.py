"""Near-real-time updates: a stream of changes applied to a store, one version per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.sources.store import Store


def apply_changes(changes: DataFrame, store: Store, checkpoint: str, deleted: str | None = None, order: str | None = None, every: str | None = None, once: bool = False):
    """Applies each micro-batch as one version; rows whose `deleted` column is true are deletes.

    Of several changes of a key in a batch the last by `order` holds, deletes included; without an order a key may stand
    once in a batch. A batch that is tried again gives the same rows.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            store.change(rows, F.col(deleted) if deleted else None, F.col(order) if order else None)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once or not every else writer.trigger(processingTime=every)).start()


def latest_by_key(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest value of each key in a stream of changes, as a running aggregate."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(key, "v.*")
