"""Key-value and retained state from streams: every micro-batch is folded into a new snapshot version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.kv import KvTable
from sluice.operators.router import Retained, TopicRouter
from sluice.sources.snapshots import Snapshots, merge_latest


def _latest(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: str, **trigger) -> StreamingQuery:
    def fold(batch: DataFrame, version: int) -> None:
        snapshots = Snapshots(batch.sparkSession, root)
        merge_latest(snapshots, batch, version, keys, order)
        snapshots.prune()

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_kv(ops: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the last op of each key of a kv_ops stream in a snapshot under root."""
    return _latest(ops, root, checkpoint, ["key"], "op_seq", **trigger)


def kv(snapshots: Snapshots, **options) -> KvTable:
    return KvTable(snapshots.read(), **options)


def keep_retained(publishes: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the last retained publish of each topic."""
    return _latest(publishes.filter("retain"), root, checkpoint, ["topic"], "pub_seq", **trigger)


def retained(snapshots: Snapshots, **options) -> Retained:
    return Retained(snapshots.read(), **options)


def route(publishes: DataFrame, subs: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Deliveries of each micro-batch, appended under out; a repeated batch overwrites its own folder."""

    def deliver(batch: DataFrame, version: int) -> None:
        TopicRouter(batch, subs).deliveries().write.mode("overwrite").parquet(f"{out}/batch={version}")

    return publishes.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
