"""Op logs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.payload import encode_json
from sluice.operators.eventlog import with_seq


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, seq, ts, payload, event_id: one topic for each event type."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "ts", "event_id", encode_json(F.col("props")).alias("payload"))
    return with_seq(events, "event_id").select("topic", "seq", "ts", "payload", "event_id")


def kv_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events; an error deletes."""
    kind = F.col("event_type")
    ttl = F.when(kind == "signup", 0).when(kind == "purchase", 864_000).when(kind == "view", 172_800).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_seq"), "ts", F.when(kind == "error", "del").otherwise("set").alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(kind != "error", encode_json(F.col("props"))).alias("payload"), ttl.alias("ttl_s"),
    )


def publishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.concat(F.lit("evt/"), F.col("event_type"), F.lit("/u"), (F.col("user_id") % 10).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pub_seq"), "ts", topic.alias("topic"), encode_json(F.col("props")).alias("payload"), (F.col("event_id") % 5 == 0).alias("retain"), F.lit(None).cast("long").alias("ttl_s")
    )


def subscription_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation connects and subscribes; c0 has an overlapping second pattern; every seventh unsubscribes, every ninth disconnects."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    pattern = F.when(region == 0, "evt/#").when(region == 1, F.concat(F.lit("evt/+/u"), (key % 10).cast("string"))).when(region == 2, "evt/purchase/+").when(region == 3, "evt/error/u3").otherwise("#")
    none, is0 = F.lit(None).cast("string"), key == 0
    steps = [("connect", none, F.lit(True)), ("sub", pattern, F.lit(True)), ("sub", F.lit("evt/purchase/u1"), is0), ("unsub", pattern, key % 7 == 5), ("disconnect", none, key % 9 == 8)]
    ops = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(op).alias("op"), p.alias("pattern"), when.alias("when")) for i, (op, p, when) in enumerate(steps)])
    rows = table(spark, sf_dir, "nation").select(key.cast("long").alias("key"), F.explode(ops).alias("s")).filter("s.when")
    return rows.select((F.col("s.step") * 1000 + F.col("key")).alias("op_seq"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("ts"), F.col("s.op").alias("op"), F.concat(F.lit("c"), F.col("key").cast("string")).alias("client_id"), F.col("s.pattern").alias("pattern"))


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages: queue, id, priority, enqueue order, and states that follow from the key.

    failures is how often the message fails; every third is in flight, due 30 s after its order date.
    """
    priority = (5 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("smallint")
    failures, flying = (F.col("o_orderkey") % 8).cast("int"), F.col("o_orderkey") % 3 == 0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("queue"), F.col("o_orderkey").alias("id"), priority.alias("priority"), F.struct("o_orderdate", "o_orderkey").alias("enqueue_ord"), F.col("o_orderdate").alias("created_at"),
        failures.alias("failures"), F.when(flying, failures).otherwise(0).alias("attempts"), F.when(flying, F.col("o_orderdate") + F.expr("interval 30 seconds")).otherwise(F.col("o_orderdate")).alias("visible_at"),
        F.when(flying, "inflight").otherwise("ready").alias("state"), encode_json(F.to_json(F.struct(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")))).alias("payload"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, group_id, seq, delivered_at, deliveries, acked: two groups that have had every event; a few are not acknowledged."""
    base = log(spark, sf_dir).select("topic", "seq", F.col("ts").alias("delivered_at"), (1 + F.col("event_id") % 6).cast("int").alias("deliveries"), "event_id")
    groups = F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("group_id")
    acked = F.when(F.col("group_id") == "g1", F.col("event_id") % 1009 != 500).otherwise(F.col("event_id") % 211 != 100)
    return base.select("*", groups).select("topic", "group_id", "seq", "delivered_at", "deliveries", acked.alias("acked"))
