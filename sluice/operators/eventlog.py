"""Ordered append-only log: sequence numbers, ranges, segments, retention and record checks.

log(topic, seq, ts, payload), seq from 1 without gaps for each topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.common import PAGE_CAP, PAGE_DEFAULT, RETENTION_BYTES, RETENTION_MS, SEGMENT_BYTES, first_by, page

#: Bytes of a record beside its payload.
RECORD_BYTES = 24


def with_seq(events: DataFrame, order: str, topic: str = "topic", time: str = "ts", width_s: int = 60) -> DataFrame:
    """events plus seq: 1, 2, ... for each topic by (time, order), which is unique.

    Numbers are given within (topic, stretch of time) and shifted by the counts of earlier stretches, so the busiest
    topic is numbered by as many tasks as it has stretches, not by one.  Numbering and the join of the counts share one
    exchange; only the counts, a row for each stretch, are summed up by topic.
    """
    stretch = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (width_s * 1_000_000))
    cut = events.withColumn("_stretch", stretch)
    before = Window.partitionBy(topic).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(topic, "_stretch").agg(F.count(F.lit(1)).alias("_n")).select(topic, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(topic, "_stretch").orderBy(time, order)).cast("long")
    return cut.withColumn("_local", local).join(base, [topic, "_stretch"]).withColumn("seq", F.col("_local") + F.col("_base")).drop("_local", "_base", "_stretch")


def record_bytes(payload: Column) -> Column:
    return F.coalesce(F.octet_length(payload), F.lit(0)).cast("long") + RECORD_BYTES


def record(seq: Column, ts: Column, payload: Column) -> Column:
    """A record's bytes: length, checksum, seq, time in ms, payload; big-endian."""
    body = F.concat(number_bytes(seq, 8), number_bytes(F.unix_millis(ts.cast("timestamp")), 8), payload)
    return F.concat(number_bytes(F.octet_length(payload) + 16, 4), number_bytes(F.crc32(body), 4), body)


def number_bytes(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def checksum(seq: Column, ts: Column, payload: Column) -> Column:
    return F.crc32(F.concat(number_bytes(seq, 8), number_bytes(F.unix_millis(ts.cast("timestamp")), 8), payload))


class EventLog:
    def __init__(self, log: DataFrame):
        self.log = log

    def read(self, topic: str, start: int, limit: int, head: int = 1) -> DataFrame:
        """At most limit rows of a topic from seq max(start, head, 1) on, in order."""
        return page(self.log.filter((F.col("topic") == topic) & (F.col("seq") >= max(start, head, 1))), [F.col("seq")], 0, limit)

    def tail(self, topic: str, limit: int = PAGE_DEFAULT, start: int | None = None) -> DataFrame:
        """The inspection view: newest first; from `start` on if given, else the last `limit` rows."""
        limit = min(limit, PAGE_CAP)
        own = self.log.filter(F.col("topic") == topic)
        if start is None:
            return own.orderBy(F.col("seq").desc()).limit(limit)
        return page(own.filter(F.col("seq") >= max(start, 1)), [F.col("seq")], 0, limit).orderBy(F.col("seq").desc())

    def last(self) -> DataFrame:
        return self.log.groupBy("topic").agg(F.max("seq").alias("last_seq"))

    def snapshot(self, groups: DataFrame) -> DataFrame:
        """groups(topic, group_id, ack_floor, pending) -> topic, last_seq, group_id, ack_floor, pending; topics without groups once."""
        return self.last().join(groups, "topic", "left").select("topic", "last_seq", "group_id", "ack_floor", "pending")

    def segments(self, rows: int = 100) -> DataFrame:
        """topic, segment, start_seq, rows, bytes, newest: segments of a fixed number of rows."""
        cut = self.log.withColumn("segment", F.floor((F.col("seq") - 1) / rows))
        return cut.groupBy("topic", "segment").agg(F.min("seq").alias("start_seq"), F.count(F.lit(1)).alias("rows"), F.sum(record_bytes(F.col("payload"))).alias("bytes"), F.max("ts").alias("newest"))

    def rolled(self, most: int = SEGMENT_BYTES) -> DataFrame:
        """topic, seq, segment: exact greedy rolling; a segment is named by its first seq.

        Each boundary depends on the one before, so a topic is folded by one task, over two numbers a row.
        """

        def fold(table):
            import pyarrow as pa

            table = table.sort_by("seq")
            out, size, name = [], 0, None
            for seq, each in zip(table["seq"].to_pylist(), table["bytes"].to_pylist(), strict=True):
                if name is None or (size and size + each > most):
                    name, size = seq, 0
                size += each
                out.append(name)
            return table.select(["topic", "seq"]).append_column("segment", pa.array(out, pa.int64()))

        slim = self.log.select("topic", "seq", record_bytes(F.col("payload")).alias("bytes"))
        return slim.groupBy("topic").applyInArrow(fold, "topic string, seq long, segment long")


def retained_segments(segments: DataFrame, as_of: Column, most_bytes: int | None = RETENTION_BYTES, most_ms: int | None = RETENTION_MS) -> DataFrame:
    """Segments that stay: not older than most_ms, and the newest that fit most_bytes together; the last always stays.

    None or 0 means unlimited.  Age is taken first, as a prefix of the topic, then size.
    """
    newest_first = Window.partitionBy("topic").orderBy(F.col("segment").desc())
    upto = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = segments.withColumn("_place", F.row_number().over(newest_first)).withColumn("_sum", F.sum("bytes").over(upto))
    keep = F.lit(True)
    if most_bytes:
        keep = keep & (F.col("_sum") <= most_bytes)
    if most_ms:
        fresh = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(F.col("newest").cast("timestamp")) <= most_ms
        keep = keep & fresh
    return out.filter((F.col("_place") == 1) | keep).drop("_place", "_sum")


def heads(segments: DataFrame) -> DataFrame:
    """topic, head_seq: the first seq that segments still hold."""
    return segments.groupBy("topic").agg(F.min("start_seq").alias("head_seq"))


def configured(config_ops: DataFrame) -> DataFrame:
    """The configuration of each topic: the first one written wins."""
    return first_by(config_ops, ["topic"], "op_seq")


def next_seq(log: DataFrame) -> DataFrame:
    """topic, next_seq."""
    return log.groupBy("topic").agg((F.max("seq") + 1).alias("next_seq"))
