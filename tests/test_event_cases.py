"""Small cases of each subsystem."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import patterns
from sluice.functions import payload as pl
from sluice.functions.common import at, checked_name, page
from sluice.operators import eventlog, groups, router, workqueue
from sluice.operators.eventlog import EventLog
from sluice.operators.kv import KvTable
from sluice.operators.router import Retained, TopicRouter

KV = "op_seq long, ts string, op string, key string, payload binary, ttl_s long"
PUB = "pub_seq long, ts string, topic string, payload binary, retain boolean, ttl_s long"
T0 = "2024-01-01 00:00:00"


def timed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_kv_overwrite_ttl_delete(spark, rows):
    ops = timed(
        spark.createDataFrame(
            [(1, T0, "set", "a", b"\x01x", None), (2, T0, "set", "a", b"\x01y", 0), (3, T0, "set", "b", b"\x01z", 1), (4, T0, "set", "c", b"\x01c", None), (5, T0, "del", "c", None, None)], KV
        )
    )
    kv = KvTable(ops)
    text = pl.text(F.col("payload"))
    assert rows(kv.live(at("2024-01-01 00:00:01")), "key", text) == [("a", "y"), ("b", "z")]  # live up to and at its expiry
    assert rows(kv.live(at("2024-01-01 00:00:01.001")), "key") == [("a",)]
    assert rows(kv.live(at("2024-01-01 01:00:00")), "key") == [("a",)]  # ttl 0 is the default of an hour
    assert rows(kv.live(at("2024-01-01 01:00:01")), "key") == []
    assert rows(kv.swept(at("2024-01-01 00:30:00")), "key") == [("b",)]
    assert rows(KvTable(kv.compacted(at("2024-01-01 00:00:01"))).live(at("2024-01-01 00:00:01")), "key") == [("a",), ("b",)]


@pytest.mark.parametrize(
    "pattern,topic,hit",
    [
        ("home/+/status", "home/kitchen/status", True), ("home/+/status", "home/kitchen/fridge/status", False), ("home/+/status", "home/status", False),
        ("logs/#", "logs/error", True), ("logs/#", "logs/app/backend/error", True), ("logs/#", "logs", True), ("logs/#", "logsx", False), ("#", "anything/at/all", True), ("#", "", True),
        ("a/#/b", "a/x", True), ("home/+/status", "home//status", True), ("$x/+", "$x/y", True), ("a+b", "a+b", True), ("a+b", "axb", False), ("a#", "a#", True), ("a#", "ab", False),
        ("+", "x", True), ("+/+", "x", False), ("+/#", "x", True), ("a.c", "abc", False), ("q\\Ez", "q\\Ez", True), ("x/+", "x/a\nb", True),
    ],
)
def test_wildcards(spark, pattern, topic, hit):
    df = spark.createDataFrame([(pattern, topic)], "pattern string, topic string")
    assert df.select(patterns.matches(F.col("topic"), F.col("pattern"))).first()[0] is hit
    subs = df.select("pattern", F.lit("c").alias("client_id"))
    assert router.matched(df.select("topic"), subs).count() == int(hit)


def test_fan_out(spark, rows):
    pubs = timed(spark.createDataFrame([(1, T0, "sensors/kitchen/temp", b"\x01a", False, None), (2, T0, "none", b"\x01b", False, None)], PUB))
    subs = spark.createDataFrame([("c", "sensors/+/temp"), ("c", "sensors/kitchen/+"), ("d", "#")], "client_id string, pattern string")
    r = TopicRouter(pubs, subs)
    assert rows(r.deliveries(), "pub_seq", "client_id") == [(1, "c"), (1, "d"), (2, "d")]
    assert rows(r.per_pattern(), "pub_seq", "client_id") == [(1, "c"), (1, "c"), (1, "d"), (2, "d")]
    assert rows(TopicRouter(pubs, subs.filter("client_id = 'c'")).counts(), "pub_seq", "delivered") == [(1, 1), (2, 0)]


def test_subscription_ops(spark, rows):
    ops = spark.createDataFrame(
        [(1, "connect", "a", None), (2, "sub", "a", "x"), (3, "sub", "a", "x"), (4, "sub", "b", "x"), (5, "connect", "b", None), (6, "sub", "b", "y"), (7, "unsub", "b", "y"), (8, "connect", "c", None), (9, "sub", "c", "z"), (10, "disconnect", "c", None)],
        "op_seq long, op string, client_id string, pattern string",
    )
    assert rows(router.subscriptions(ops), "client_id", "pattern") == [("a", "x")]
    assert router.active_clients(ops).first()[0] == 2


def test_retained(spark, rows):
    pubs = timed(
        spark.createDataFrame(
            [
                (1, T0, "t", b"\x01v1", True, None), (2, T0, "t", b"\x01v2", True, None), (3, T0, "t", b"\x01v3", True, None), (4, T0, "t", b"\x01n", False, None),
                (5, T0, "gone", b"\x01v", True, None), (6, T0, "gone", b"", True, None), (7, T0, "null", b"\x01v", True, None), (8, T0, "null", None, True, None), (9, T0, "zero", b"\x01v", True, 0), (10, T0, "s/a", b"\x01q", True, 2),
            ],
            PUB,
        )
    )
    held = Retained(pubs)
    assert rows(held.live(at("2024-01-01 00:00:01")), "topic", pl.text(F.col("payload"))) == [("s/a", "q"), ("t", "v3")]
    assert rows(held.live(at("2024-01-01 00:00:02")), "topic") == [("t",)]
    subs = spark.createDataFrame([("c", "#"), ("d", "s/+")], "client_id string, pattern string")
    assert rows(held.replay(subs, at("2024-01-01 00:00:01")), "client_id", "topic") == [("c", "s/a"), ("c", "t"), ("d", "s/a")]
    listed = router.topics(subs, held, at("2024-01-01 00:00:02"))
    assert rows(listed, "path", "subscribers", F.col("payload").isNull()) == [("#", 1, True), ("s/+", 1, True), ("s/a", 0, True), ("t", 0, False), ("zero", 0, True)]


def queue_ops(spark, *ops):
    fields = ("at", "op", "id", "priority", "max_n", "reason")
    full = [(i, "q", *(dict(zip(fields, op, strict=False)).get(f) for f in fields)) for i, op in enumerate(ops)]
    df = spark.createDataFrame(full, "op_seq long, queue string, at long, op string, id string, priority int, max_n int, reason string")
    return df.withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz")).withColumn("payload", F.lit(None).cast("binary"))


def delivered(df):
    return [(r.id, r.attempt) for r in df.filter("op = 'consume' and attempt is not null").orderBy("op_seq", F.monotonically_increasing_id()).collect()]


def test_queue_order(spark):
    ops = queue_ops(spark, (0, "push", "low", 0), (0, "push", "high", 10), (0, "push", "mid", 7), *[(0, "push", f"msg{i}", 4) for i in (1, 2, 3)], *[(1, "consume", None, None, 1)] * 6)
    assert [i for i, _ in delivered(workqueue.fold_queues(ops))] == ["high", "mid", "msg1", "msg2", "msg3", "low"]


def test_queue_retries_and_replay(spark, rows):
    ops = queue_ops(spark, (0, "push", "m", 0), *[(40 * i, "consume", None, None, 1) for i in range(4)], (200, "dlq_replay", "m"), (201, "consume", None, None, 1))
    out = workqueue.fold_queues(ops, max_retries=3)
    assert delivered(out) == [("m", 1), ("m", 2), ("m", 3), ("m", 1)]
    dead = workqueue.queue_states(ops.filter("op_seq < 5"), max_retries=3)
    assert rows(dead, "id", "state", "attempts", "reason") == [("m", "dlq", 3, "Timeout")]


def test_queue_nack_goes_to_the_tail(spark):
    ops = queue_ops(spark, (0, "push", "a", 1), (0, "push", "b", 1), (1, "consume", None, None, 1), (2, "nack", "a", None, None, "boom"), (3, "consume", None, None, 2), (4, "ack", "b"), (5, "ack", "missing"))
    out = workqueue.fold_queues(ops)
    assert delivered(out) == [("a", 1), ("b", 1), ("a", 2)]
    assert [r.effect for r in out.filter("op = 'ack'").orderBy("op_seq").collect()] == [True, False]


def test_queue_batches_and_purge(spark):
    ops = queue_ops(spark, *[(0, "push", f"m{i}", 0) for i in range(10)], (1, "consume", None, None, 4), (1, "consume", None, None, 10), (1, "consume", None, None, 10))
    assert [i for i, _ in delivered(workqueue.fold_queues(ops))] == [f"m{i}" for i in range(10)]
    ops = queue_ops(spark, *[(0, "push", f"m{i}", 0) for i in range(3)], (1, "consume", None, None, 3), (2, "nack", "m0", None, None, "e"), (2, "nack", "m1", None, None, "e"), (2, "nack", "m2", None, None, "e"), (3, "dlq_delete", "m0"), (4, "dlq_purge"))
    assert [r.dlq for r in workqueue.fold_queues(ops, max_retries=1).filter("op_seq >= 6").orderBy("op_seq").collect()] == [3, 2, 0]


@pytest.mark.parametrize("failures,retries,deliveries,outcome", [(0, 3, 1, "done"), (2, 3, 3, "done"), (3, 3, 3, "dlq"), (9, 3, 3, "dlq"), (0, 0, 1, "done"), (1, 0, 1, "dlq"), (1, 1, 1, "dlq")])
def test_queue_outcomes(spark, failures, retries, deliveries, outcome):
    df = spark.createDataFrame([(failures, retries)], "f int, m int")
    got = workqueue.outcomes(df, F.col("f"), F.col("m")).first()
    assert (got.deliveries, got.outcome) == (deliveries, outcome)
    step = [x for i in range(failures + 1) for x in ((i, "consume", None, None, 1), (i, "nack", "m", None, None, "e") if i < failures else (i, "ack", "m"))]
    folded = workqueue.fold_queues(queue_ops(spark, (0, "push", "m", 0), *step), max_retries=retries)
    assert len(delivered(folded)) == deliveries
    assert folded.orderBy(F.col("op_seq").desc()).first().dlq == (outcome == "dlq")


def group_ops(spark, *ops, last=10):
    fields = ("at", "op", "consumer_id", "generation", "seq", "max_n")
    full = [("t", "g", i, *(dict(zip(fields, op, strict=False)).get(f) for f in fields)) for i, op in enumerate(ops)]
    df = spark.createDataFrame(full, "topic string, group_id string, op_seq long, at long, op string, consumer_id string, generation long, seq long, max_n int").withColumn("ts", F.timestamp_seconds("at"))
    return df, spark.createDataFrame([("t", 1, last)], "topic string, head_seq long, last_seq long")


def test_ack_floor_with_holes(spark):
    out = groups.fold_groups(*group_ops(spark, (0, "join", "c"), (0, "fetch", "c", 1, None, 5), (1, "ack", "c", 1, 1), (1, "ack", "c", 1, 3), (1, "ack", "c", 1, 2)))
    assert [r.ack_floor for r in out.filter("op = 'ack'").orderBy("op_seq").collect()] == [1, 1, 3]


def test_redelivery_then_park(spark):
    ops = group_ops(spark, (0, "join", "c"), *[(40 * i, "fetch", "c", 1, None, 1) for i in range(3)], (90, "ack", "c", 1, 2), (91, "ack", "c", 1, 7), last=2)
    out = groups.fold_groups(*ops, max_deliveries=2)
    assert [(r.seq, r.attempt) for r in out.filter("op = 'fetch'").orderBy("op_seq").collect()] == [(1, 1), (1, 2), (2, 1)]
    last = out.orderBy("op_seq").collect()
    assert ([s for r in last for s in r.parked], last[-2].ack_floor, last[-1].rejected) == ([1], 2, "NOT_PENDING")


def test_seek_fences(spark):
    acks = [(1, "ack", "c", 1, i) for i in range(1, 11)]
    out = groups.fold_groups(*group_ops(spark, (0, "join", "c"), (0, "fetch", "c", 1, None, 10), *acks, (2, "seek_beginning"), (3, "fetch", "c", 1, None, 10), (4, "fetch", "c", 2, None, 10), (5, "join", "c"), (6, "fetch", "c", 2, None, 10), (7, "seek_end"), (8, "join", "c"), (9, "fetch", "c", 3, None, 10)))
    by = {}
    for r in out.orderBy("op_seq", "seq").collect():
        by.setdefault(r.op_seq, []).append(r)
    assert by[13][0].rejected == "FENCED"
    assert by[14][0].rejected == "NOT_MEMBER"
    assert [r.seq for r in by[16]] == list(range(1, 11))
    assert (by[19][0].attempt, by[19][0].ack_floor) == (None, 10)


def test_two_consumers_do_not_overlap(spark):
    out = groups.fold_groups(*group_ops(spark, (0, "join", "a"), (0, "join", "b"), (0, "fetch", "a", 1, None, 4), (0, "fetch", "b", 1, None, 4), (1, "ack", "b", 1, 1), (2, "leave", "a"), (3, "fetch", "b", 1, None, 4)))
    got = {}
    for r in out.filter("op = 'fetch'").collect():
        got.setdefault(r.op_seq, set()).add(r.seq)
    assert got[2] == {1, 2, 3, 4} and got[3] == {5, 6, 7, 8} and got[6] == {1, 2, 3, 4}
    assert out.filter("op = 'ack'").first().rejected == "NOT_OWNER"


def test_backpressure_and_clamp(spark):
    out = groups.fold_groups(*group_ops(spark, (0, "join", "a"), (0, "fetch", "a", 1, None, 9), (1, "fetch", "a", 1, None, 9)), max_ack_pending=3)
    assert out.filter("op = 'fetch' and attempt is not null").count() == 3
    state = groups.GroupState(1, 10)
    state.apply("join", 0, "a")
    state.apply("fetch", 0, "a", 1, None, 3)
    state.clamp(6)
    assert (state.floor, state.next, state.pending) == (5, 6, {})


def test_the_log_moves_while_a_group_reads(spark):
    """Rows are not delivered before they are published; what retention dropped is neither redelivered nor acknowledged."""
    ops, _ = group_ops(spark, (0, "join", "a"), (0, "fetch", "a", 1, None, 9), (0, "publish", None, None, 3), (1, "fetch", "a", 1, None, 2), (1, "publish", None, None, 6), (2, "head", None, None, 3), (2, "ack", "a", 1, 1), (3, "fetch", "a", 1, None, 9), (99, "fetch", "a", 1, None, 9))
    out = groups.fold_groups(ops, spark.createDataFrame([("t", 1, 0)], "topic string, head_seq long, last_seq long")).orderBy("op_seq", "seq").collect()
    fetched = {}
    for r in out:
        if r.attempt is not None:
            fetched.setdefault(r.op_seq, []).append((r.seq, r.attempt))
    assert fetched == {3: [(1, 1), (2, 1)], 7: [(3, 1), (4, 1), (5, 1), (6, 1)], 8: [(3, 2), (4, 2), (5, 2), (6, 2)]}
    assert [(r.rejected, r.ack_floor) for r in out if r.op == "ack"] == [("NOT_PENDING", 2)]


def test_log_numbers_are_contiguous(spark):
    rows = [("a" if i % 3 else "b", i, f"2024-01-{1 + i % 20:02d} 00:00:00") for i in range(200)]
    df = timed(spark.createDataFrame(rows, "topic string, id long, ts string"))
    got = eventlog.with_seq(df, "id").orderBy("topic", "ts", "id").collect()
    for topic in "ab":
        own = [r.seq for r in got if r.topic == topic]
        assert own == list(range(1, len(own) + 1))
    log = EventLog(eventlog.with_seq(df, "id").withColumn("payload", F.lit(b"x")))
    assert log.read("a", 1000, 5).count() == 0 and log.read("nowhere", 1, 5).count() == 0
    assert [r.seq for r in log.tail("b", 3).collect()] == [67, 66, 65]


def test_segments_and_retention(spark, rows):
    log = spark.createDataFrame([("t", i, b"x" * 46) for i in range(1, 8)], "topic string, seq long, payload binary").withColumn("ts", at(T0))
    rolled = EventLog(log).rolled(100)
    assert rows(rolled.select("segment").distinct()) == [(i,) for i in range(1, 8)]
    segments = EventLog(log).segments(1)
    kept = eventlog.retained_segments(segments, at(T0), 250, None)
    assert rows(eventlog.heads(kept)) == [("t", 5)]
    assert rows(eventlog.heads(eventlog.retained_segments(segments, at("2024-02-01 00:00:00"), None, 1000))) == [("t", 7)]
    assert eventlog.retained_segments(segments, at(T0), 0, 0).count() == 7


def test_payloads(spark):
    cases = [(b'\x02{"a":{"b":[1,"\xc3\xa9"]}}', "json", '{"a":{"b":[1,"é"]}}'), (b"\x01", "string", ""), (b"\x02null", "json", "null"), (b"\x00\x00\xff", "raw", "0x00ff"), (b"", None, None), (b'{"k":1}', "json", '{"k":1}'), (b"\x01\xffz", "string", "�z"), (None, None, None)]
    df = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(cases)], "i int, payload binary")
    p = F.col("payload")
    got = df.select("i", pl.kind(p), pl.text(p), F.to_json(pl.json_value(p)), pl.field(p, "$.k", "int")).orderBy("i").collect()
    assert [tuple(r)[1:3] for r in got] == [(k, t) for _, k, t in cases]
    assert got[3][3] == '"0x00ff"' and got[5][4] == 1 and got[1][3] == '""' and got[2][3] == "null"


def test_paging_and_names(spark):
    df = spark.range(10)
    assert [r.id for r in page(df, [F.col("id").desc()], 2, 3).collect()] == [7, 6, 5]
    assert page(df, [F.col("id")], 0, 100, cap=4).count() == 4
    with pytest.raises(ValueError):
        page(df, [F.col("id")], -1)
    for bad in ("../x", "a/b", "", ".."):
        with pytest.raises(ValueError):
            checked_name(bad)


def test_assign_matches_fold(spark, rows):
    log = spark.range(1, 3000).select(F.lit("t").alias("topic"), F.col("id").alias("seq"))
    fetches = spark.createDataFrame([("t", "g", 1, "a", 1500), ("t", "g", 2, "b", 0), ("t", "g", 3, "b", 700)], "topic string, group_id string, fetch_ord long, consumer_id string, max_n long")
    got = groups.assign(log, fetches)
    assert rows(got.groupBy("consumer_id").agg(F.min("seq"), F.max("seq"), F.count("seq"))) == [("a", 1, 1500, 1500), ("b", 1501, 2200, 700)]


def test_restart_disconnect_and_budget(spark, rows):
    floors = spark.createDataFrame([("t", "g", 5), ("t", "h", 1)], "topic string, group_id string, ack_floor long")
    heads = spark.createDataFrame([("t", 4)], "topic string, head_seq long")
    assert rows(groups.restored(floors, heads), "group_id", "ack_floor", "next_deliver") == [("g", 5, 6), ("h", 3, 4)]
    members = spark.createDataFrame([("x", "t", "g", "w"), ("y", "t", "g", "v")], "client_id string, topic string, group_id string, consumer_id string")
    gone = spark.createDataFrame([("x", 9)], "client_id string, op_seq long").withColumn("ts", at(T0))
    assert rows(groups.disconnected(members, gone), "op", "consumer_id", "op_seq") == [("leave", "w", 9)]
    assert spark.range(1).select(groups.budget(F.lit(10), F.lit(9_995)), groups.budget(F.lit(10), F.lit(10_050))).first()[:] == (5, 0)


def test_bytes_and_limits(spark):
    df = spark.createDataFrame([(b"\x01\x00\x00\x01\x02\xff",)], "p binary")
    assert df.select(pl.read_uint(F.col("p"), 1, 4), pl.read_uint(F.col("p"), 5, 1), pl.within_limit(F.col("p"), 6), pl.within_limit(F.col("p"), 5)).first()[:] == (258, 255, True, False)


def test_queue_names_and_unknown_pushes(spark, rows):
    ops = spark.createDataFrame([(1, "a", "create"), (2, "b", "create"), (3, "b", "delete")], "op_seq long, queue string, op string")
    assert rows(workqueue.existing(ops)) == [("a",)]
    pushes = spark.createDataFrame([("a", "1"), ("c", "2")], "queue string, id string")
    assert rows(workqueue.unknown_queue(pushes, workqueue.existing(ops)), "id", "reason") == [("2", "Queue not found")]


def test_no_nested_loops_and_top_k_plans(spark):
    from sluice.plans.catalogue import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    for name in ("fanout", "fanout_zero", "retained_replay", "group_assign"):
        assert "NestedLoop" not in plan(name) and "Cartesian" not in plan(name)
    assert "WindowGroupLimit" in plan("q_dispatch_topk") and "TakeOrderedAndProject" in plan("log_range")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)" in plan("q_pending_page")
