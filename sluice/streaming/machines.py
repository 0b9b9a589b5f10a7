"""Queue and consumer-group machines over streams: the same folds as in batch, with event-time timers.

State is one value for each queue or group.  Ops of a micro-batch are applied in op_seq order; a timer is set for the
head of the deadline heap and fires once the watermark has passed it, so a stream reaches the batch fold's end state;
a head whose message has moved on costs one early call.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.operators.groups import GroupState
from sluice.operators.workqueue import QueueState

QUEUE_OUT = "queue string, op_seq long, op string, id string, attempt int, pending int, inflight int, dlq int"
GROUP_OUT = "topic string, group_id string, op_seq long, op string, seq long, attempt int, rejected string, ack_floor long, pending int, parked int"
SEQ_OUT = "topic string, order_id long, seq long"


class _Machine(StatefulProcessor):
    def __init__(self, **limits: int):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data binary")

    def _load(self):
        return pickle.loads(self.state.get()[0]) if self.state.exists() else self.fresh()

    def _save(self, machine) -> None:
        self.state.update((pickle.dumps(machine),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = self.due(machine)
        if due is not None:
            self.handle.registerTimer(due)

    def _expire(self, now: int) -> None:
        machine = self._load()
        machine.expire(now)
        self._save(machine)

    def close(self) -> None:
        pass


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("op_seq")


def _given(value):
    return None if pd.isna(value) else value


class QueueMachine(_Machine):
    def fresh(self) -> QueueState:
        return QueueState(**self.limits)

    def due(self, machine: QueueState) -> int | None:
        return machine.deadlines[0] if machine.deadlines else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, out = self._load(), []
        for r in _ordered(rows).itertuples(index=False):
            priority, most = _given(r.priority), _given(r.max_n)
            found, _ = machine.apply(r.op, int(r.at_ms), _given(r.id), None if priority is None else int(priority), None if most is None else int(most), _given(r.reason))
            ready = machine.ready
            for id_, attempt in found or [(_given(r.id), None)]:
                out.append((key[0], int(r.op_seq), r.op, id_, attempt, ready, len(machine.messages) - ready, len(machine.dead)))
        self._save(machine)
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in QUEUE_OUT.split(", ")])
        yield frame.astype({"attempt": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._expire(expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame(columns=[x.split()[0] for x in QUEUE_OUT.split(", ")])


class GroupMachine(_Machine):
    def fresh(self) -> GroupState:
        return GroupState(1, 0, **self.limits)

    def due(self, machine: GroupState) -> int | None:
        return machine.due[0][0] + 1 if machine.due else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, out = self._load(), []
        for r in _ordered(rows).itertuples(index=False):
            number = lambda x: None if pd.isna(x) else int(x)
            found, why = machine.apply(r.op, int(r.at_ms), _given(r.consumer_id), number(r.generation), number(r.seq), number(r.max_n))
            for seq, attempt in found or [(number(r.seq), None)]:
                out.append((key[0], key[1], int(r.op_seq), r.op, seq, attempt, why, machine.floor, len(machine.pending), len(machine.parked)))
        self._save(machine)
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in GROUP_OUT.split(", ")])
        yield frame.astype({"attempt": "Int32", "seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._expire(expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame(columns=[x.split()[0] for x in GROUP_OUT.split(", ")])


class Sequencer(StatefulProcessor):
    """A counter for each topic."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        ids = pd.concat(list(rows)).sort_values(["at_ms", "order_id"])["order_id"]
        self.last.update((last + len(ids),))
        yield pd.DataFrame({"topic": key[0], "order_id": ids.to_numpy(), "seq": range(last + 1, last + 1 + len(ids))})

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late)


def queue_stream(ops: DataFrame, late: str = "0 seconds", **limits: int) -> DataFrame:
    """A queue_ops stream -> QUEUE_OUT, append mode."""
    return _timed(ops, late).groupBy("queue").transformWithStateInPandas(QueueMachine(**limits), QUEUE_OUT, "append", "eventTime")


def group_stream(ops: DataFrame, late: str = "0 seconds", **limits: int) -> DataFrame:
    """A group_ops stream, in which op publish with a seq says how far the log goes, -> GROUP_OUT, append mode."""
    return _timed(ops, late).groupBy("topic", "group_id").transformWithStateInPandas(GroupMachine(**limits), GROUP_OUT, "append", "eventTime")


def sequence_stream(events: DataFrame) -> DataFrame:
    """events(topic, ts, order_id) -> SEQ_OUT: numbers from 1 for each topic in order of arrival, by time within a micro-batch."""
    return events.withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp"))).groupBy("topic").transformWithStateInPandas(Sequencer(), SEQ_OUT, "append", "none")
