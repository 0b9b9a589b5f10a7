"""Queue folds over long queues: time an op, results across batches and queues, memory."""

import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sluice.operators import workqueue
from sluice.operators.workqueue import QueueState


def test_an_op_takes_no_longer_when_more_messages_wait():
    def seconds(waiting):
        state = QueueState()
        for i in range(waiting):
            state.apply("push", 0, f"w{i}", 0)
        began = time.process_time()
        for i in range(5000):
            state.apply("push", 0, f"m{i}", 1)
            state.apply("consume", 0, None, None, 1)
            state.apply("ack", 0, f"m{i}")
            state.apply("nack", 0, f"w{i}", None, None, "boom")
        assert state.ready == waiting
        return time.process_time() - began

    assert seconds(400_000) < 10 * min(seconds(5000) for _ in range(3))


def test_acknowledged_messages_leave_the_lanes():
    state = QueueState()
    for i in range(20_000):
        state.apply("push", 0, f"m{i}", i % 3)
        if i % 100:
            state.apply("ack", 0, f"m{i}")
    assert state.ready == len(state.messages) == 200
    assert sum(map(len, state.lanes.values())) <= 300 + workqueue.STALE_LEAST
    assert [m[0] for m in state.waiting()] == [f"m{i}" for p in (2, 1, 0) for i in range(0, 20_000, 100) if i % 3 == p]
    assert [i for i, _ in state.apply("consume", 0, None, None, 2)[0]] == ["m200", "m500"]


def many_queues(spark):
    op = F.element_at(F.array(*map(F.lit, ("push", "push", "consume", "nack", "push", "consume", "ack", "consume"))), (F.col("op_seq") / 7 % 8).cast("int") + 1)
    rows = spark.range(21_000).select(F.col("id").alias("op_seq"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("q"), F.col("id") % 7)).alias("queue")).withColumn("op", op)
    turn = (F.col("op_seq") / 7).cast("int")
    return rows.select(
        "queue", "op_seq", F.timestamp_seconds(turn * 3).alias("ts"), "op", F.when(F.col("op") == "push", turn).when(F.col("op").isin("nack", "ack"), turn - F.col("op_seq") % 5).cast("string").alias("id"),
        (turn % 3).alias("priority"), (turn % 2).alias("max_n"), F.lit("boom").alias("reason"),
    )


def replayed(rows):
    states, out = {}, []
    for r in sorted(rows, key=lambda r: r.op_seq):
        state = states.setdefault(r.queue, QueueState(max_retries=2))
        found, effect = state.apply(r.op, r.at_ms, r.id, r.priority, r.max_n, r.reason)
        out += [(r.queue, r.op_seq, r.op, i, n, effect, state.ready, len(state.messages) - state.ready, len(state.dead)) for i, n in found or [(r.id, None)]]
    return states, out


def test_queues_are_folded_across_batches(spark):
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ops = many_queues(spark)
    states, want = replayed(ops.withColumn("at_ms", F.unix_millis("ts")).collect())
    try:
        spark.conf.set(key, "100")
        got = [tuple(r) for r in workqueue.fold_queues(ops, max_retries=2).collect()]
        assert len(states) == 7 and sorted(got, key=str) == sorted(want, key=str)
    finally:
        spark.conf.set(key, before)


def test_states_hold_no_history(monkeypatch):
    class Ordered:
        def mapInArrow(self, fold, schema):
            return fold

    def batch(k):
        rows = [("q", 5000 * k + j, 0, "push" if j % 2 == 0 else "ack", f"m{k}-{j // 2}", None, None, None) for j in range(5000 + (k == 39))]
        names, types = ("queue", "op_seq", "at_ms", "op", "id", "priority", "max_n", "reason"), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    monkeypatch.setattr(workqueue, "_ordered", lambda ops, config: Ordered())
    fold = workqueue.queue_states(None)
    tracemalloc.start()
    try:
        out = list(fold(batch(k) for k in range(40)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [r["id"] for b in out for r in b.to_pylist()] == ["m39-2500"]
    assert peak < 20e6  # as dicts the 200 001 ops take more than 100 MB


def test_states_of_many_queues(spark):
    ops = many_queues(spark)
    states, _ = replayed(ops.withColumn("at_ms", F.unix_millis("ts")).collect())
    kinds = {q: [("ready", [(m[0], m[2]) for m in s.waiting()]), ("inflight", [(m[0], m[2]) for m in s.flying()]), ("dlq", [(i, m[1]) for i, m in s.dead.items()])] for q, s in states.items()}
    want = [(q, i, kind, attempts, place) for q, found in kinds.items() for kind, messages in found for place, (i, attempts) in enumerate(messages)]
    got = [tuple(r) for r in workqueue.queue_states(ops, max_retries=2).select("queue", "id", "state", "attempts", "place").collect()]
    assert {k for _, _, k, _, _ in want} == {"ready", "inflight", "dlq"} and sorted(got, key=str) == sorted(want, key=str)
