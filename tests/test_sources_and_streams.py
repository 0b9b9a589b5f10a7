"""Sources, snapshots, and streams that reach the batch result."""

import pytest
from pyspark.sql import functions as F

from sluice.functions.common import at
from sluice.operators import eventlog, groups, workqueue
from sluice.operators.kv import KvTable
from sluice.operators.router import Retained, TopicRouter, subscriptions
from sluice.sources import segments, tables
from sluice.sources.snapshots import Snapshots
from sluice.streaming import latest, machines

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stop,expected", [(True, [1, 2]), (False, [1, 2, 4])])
def test_segment_files(spark, rows, tmp_path, stop, expected):
    good = [segments.encode(i, 1_700_000_000_000 + i, f"p{i}".encode()) for i in range(1, 5)]
    bad = bytearray(good[2])
    bad[-1] ^= 1
    (tmp_path / "1.log").write_bytes(good[0] + good[1] + bytes(bad) + good[3] + good[3][:9])
    got = segments.read_files(spark, str(tmp_path), stop)
    assert rows(got, "seq") == [(i,) for i in expected]
    assert rows(got, F.col("payload").cast("string"))[0] == ("p1",)


def test_record_bytes_match_the_codec(spark):
    log = spark.createDataFrame([(7, b"abc")], "seq long, payload binary").withColumn("ts", at("2024-01-01 00:00:00.123"))
    got = log.select(eventlog.record(F.col("seq"), F.col("ts"), F.col("payload")).alias("r"), eventlog.record_bytes(F.col("payload")).alias("n")).first()
    ms = 1_704_067_200_123
    assert bytes(got.r) == segments.encode(7, ms, b"abc") and got.n == len(got.r)


def test_append_and_range(spark, rows, tmp_path):
    log = tables.log(spark, DATA)
    for size in (100, segments.SEGMENT_ROWS):
        root = tmp_path / str(size)
        segments.append(log, str(root), size)
        got = segments.read_range(spark, str(root), "view", 90, 30, size)
        assert rows(got, "seq") == [(i,) for i in range(90, 120)]
        assert "PartitionFilters: [isnotnull(topic" in got._jdf.queryExecution().toString()
        assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in root.glob("topic=*/segment=*"))


def in_files(df, path, n, order):
    """df in n files that arrive in order of `order`."""
    top = df.agg(F.max(order)).first()[0]
    for i in range(n):
        df.filter((F.col(order) > top * i // n - (i == 0) * 10) & (F.col(order) <= top * (i + 1) // n)).coalesce(1).write.mode("append").parquet(path)
    return df.schema


def stream(spark, df, path, n=3, order="op_seq"):
    schema = in_files(df, path, n, order)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_kv_stream_reaches_batch(spark, rows, tmp_path):
    ops = tables.kv_ops(spark, DATA)
    latest.keep_kv(stream(spark, ops, str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    when = at("2024-01-31 00:00:00")
    assert rows(latest.kv(Snapshots(spark, str(tmp_path / "state"))).live(when)) == rows(KvTable(ops).live(when))
    assert len(Snapshots(spark, str(tmp_path / "state")).versions()) == 2


def test_retained_stream_and_routing(spark, rows, tmp_path):
    pubs = tables.publishes(spark, DATA)
    source = stream(spark, pubs, str(tmp_path / "in"), order="pub_seq")
    latest.keep_retained(source, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert rows(latest.retained(Snapshots(spark, str(tmp_path / "state"))).held()) == rows(Retained(pubs).held())
    subs = subscriptions(tables.subscription_ops(spark, DATA))
    latest.route(source, subs, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "pub_seq", "topic", "client_id") == rows(TopicRouter(pubs, subs).deliveries())


def run(df, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_queue_stream_reaches_batch(spark, rows, tmp_path):
    ops = [(i, "q", 1000 + 10 * i, "push", f"m{i}", i % 3, None, None) for i in range(20)]
    ops += [(100 + i, "q", 1200 + 15 * i, "consume" if i % 3 else "nack", None if i % 3 else f"m{i // 3}", None, 2, "e") for i in range(40)]
    df = spark.createDataFrame(ops, "op_seq long, queue string, at long, op string, id string, priority int, max_n int, reason string").withColumn("ts", F.timestamp_seconds("at"))
    batch = workqueue.fold_queues(df, max_retries=2)
    columns = ["op_seq", "op", F.coalesce("id", F.lit("")), F.coalesce("attempt", F.lit(0)), "pending", "inflight", "dlq"]
    got = run(machines.queue_stream(stream(spark, df, str(tmp_path / "in")), max_retries=2), "queue_out", tmp_path)
    assert rows(got, *columns) == rows(batch, *columns)


def test_group_stream_reaches_batch(spark, rows, tmp_path):
    ops = [(0, "publish", None, 12, None), (1, "join", "c", None, None)]
    ops += [(2 + i, "ack" if i % 4 == 3 else "fetch", "c", i // 2 if i % 4 == 3 else None, 2) for i in range(30)]
    full = [("t", "g", i, 1000 + 12 * i, op, c, 1, s, n) for i, op, c, s, n in ops]
    df = spark.createDataFrame(full, "topic string, group_id string, op_seq long, at long, op string, consumer_id string, generation long, seq long, max_n int").withColumn("ts", F.timestamp_seconds("at"))
    bounds = spark.createDataFrame([("t", 1, 0)], "topic string, head_seq long, last_seq long")
    batch = groups.fold_groups(df, bounds, max_deliveries=2)
    columns = ["op_seq", "op", F.coalesce("seq", F.lit(0)), F.coalesce("attempt", F.lit(0)), F.coalesce("rejected", F.lit("")), "ack_floor", "pending"]
    got = run(machines.group_stream(stream(spark, df, str(tmp_path / "in")), max_deliveries=2), "group_out", tmp_path)
    assert rows(got, *columns) == rows(batch, *columns)


def test_sequence_stream(spark, rows, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("topic"), "ts", F.col("event_id").alias("order_id"))
    got = run(machines.sequence_stream(stream(spark, events, str(tmp_path / "in"), order="order_id")), "seq_out", tmp_path)
    want = tables.log(spark, DATA).select("topic", F.col("event_id").alias("order_id"), "seq")
    assert rows(got, "topic", "order_id", "seq") == rows(want)
