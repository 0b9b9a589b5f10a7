"""The log on disk: Parquet by topic and segment, and a decoder for files of checksummed binary records."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = struct.Struct(">IIQQ")  # length after the first 8 bytes, checksum, seq, time in ms
DECODED = "path string, seq long, ts_ms long, payload binary"
#: Rows of a segment: some 64 MB at 250 bytes a row.
SEGMENT_ROWS = 1 << 18


def append(log: DataFrame, root: str, rows: int = SEGMENT_ROWS) -> None:
    """Append a log; a segment is a partition, so that a range read touches the files of its segments only.

    Each segment gets one file an append, ordered by seq, so that within it the row groups' bounds prune too.
    """
    cut = log.withColumn("segment", F.floor((F.col("seq") - 1) / rows))
    cut.repartition("topic", "segment").sortWithinPartitions("topic", "segment", "seq").write.mode("append").partitionBy("topic", "segment").parquet(root)


def read_range(spark: SparkSession, root: str, topic: str, start: int, limit: int, rows: int = SEGMENT_ROWS) -> DataFrame:
    """At most limit rows of a topic from start on; earlier and later segments are pruned."""
    start = max(start, 1)
    segment = F.col("segment").between((start - 1) // rows, (start + limit - 2) // rows)
    return spark.read.parquet(root).filter((F.col("topic") == topic) & segment & (F.col("seq") >= start)).orderBy("seq").limit(limit).drop("segment")


def records(data: bytes, stop_at_bad: bool) -> Iterator[tuple[int, int, bytes]]:
    """(seq, time in ms, payload) of each whole record whose checksum holds; a bad one is skipped, or ends the file."""
    at = 0
    while at + 8 <= len(data):
        size, crc = struct.unpack_from(">II", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or size < 16:
            return
        if zlib.crc32(body) == crc:
            seq, ms = struct.unpack_from(">QQ", body)
            yield seq, ms, body[16:]
        elif stop_at_bad:
            return
        at += 8 + size


def encode(seq: int, ms: int, payload: bytes) -> bytes:
    body = struct.pack(">QQ", seq, ms) + payload
    return struct.pack(">II", len(body), zlib.crc32(body)) + body


def read_files(spark: SparkSession, path: str, stop_at_bad: bool = False) -> DataFrame:
    """Binary segment files -> path, seq, ts, payload.  stop_at_bad is how recovery reads, skipping how ranges do."""

    def decode(batches):
        for batch in batches:
            rows = [(name, *r) for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True) for r in records(data.as_py(), stop_at_bad)]
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "seq", "ts_ms", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, DECODED).select("path", "seq", F.timestamp_millis("ts_ms").alias("ts"), "payload")
