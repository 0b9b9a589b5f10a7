"""Work queues: priority-then-FIFO dispatch, visibility timeout, retries and dead letters.

ops(op_seq, ts, queue, op, id, payload, priority, max_n, reason).  Closed forms answer what does not depend on the
interleaving (top-k dispatch, outcomes, counters, listings); `fold_queues` replays a log in exact order.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import payload as pl
from sluice.functions.common import CONSUME_BATCH, MAX_RETRIES, PAGE_DEFAULT, QUEUE_PAGE_CAP, VISIBILITY_MS, first_by, latest_by, page, plus_ms

TIMEOUT = "Timeout"


def configured(config_ops: DataFrame) -> DataFrame:
    """The configuration of each queue: the first one written wins."""
    return first_by(config_ops, ["queue"], "op_seq")


def existing(queue_ops: DataFrame) -> DataFrame:
    """queue: names whose last create or delete is a create."""
    return latest_by(queue_ops.filter(F.col("op").isin("create", "delete")).select("queue", "op_seq", "op"), ["queue"], "op_seq").filter("op = 'create'").select("queue")


def unknown_queue(pushes: DataFrame, config: DataFrame) -> DataFrame:
    """Pushes to queues that don't exist."""
    return pushes.join(config.select("queue"), "queue", "left_anti").withColumn("reason", F.lit("Queue not found"))


def dispatch(ready: DataFrame, n: int = CONSUME_BATCH, order: str = "enqueue_ord") -> DataFrame:
    """The next n of each queue: highest priority first, then first in; a per-partition top-k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("queue").orderBy(F.col("priority").desc(), F.col(order)))
    return ready.withColumn("rank", rank).filter(F.col("rank") <= n)


def consumed(ready: DataFrame, as_of: Column, n: int = CONSUME_BATCH, order: str = "enqueue_ord", visibility_ms: int = VISIBILITY_MS) -> DataFrame:
    """dispatch() with the state that consuming gives: in flight until the timeout, one attempt more."""
    return dispatch(ready, n, order).withColumn("attempts", F.col("attempts") + 1).withColumn("visible_at", plus_ms(as_of, F.lit(visibility_ms))).withColumn("state", F.lit("inflight"))


def acknowledged(messages: DataFrame, acks: DataFrame) -> DataFrame:
    """What is left after acks(queue, id), whatever the messages' state."""
    return messages.join(acks.select("queue", "id"), ["queue", "id"], "left_anti")


def outcomes(messages: DataFrame, failures: Column, max_retries: Column) -> DataFrame:
    """deliveries and outcome done|dlq of each message that fails `failures` times before it would succeed."""
    allowed = F.greatest(max_retries, F.lit(1))
    return messages.withColumn("deliveries", (F.least(failures, allowed) + F.when(failures < allowed, 1).otherwise(0)).cast("int")).withColumn("outcome", F.when(failures >= allowed, "dlq").otherwise("done"))


def expired(inflight: DataFrame, as_of: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """In-flight messages whose deadline has come: ready again, or dead with reason Timeout."""
    dead = F.col("attempts") >= max_retries
    return inflight.filter(F.col("visible_at") <= as_of).withColumn("state", F.when(dead, "dlq").otherwise("ready")).withColumn("reason", F.when(dead, TIMEOUT))


def nacked(messages: DataFrame, nacks: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """messages joined to nacks(queue, id, reason): dead if out of attempts, else ready at the tail."""
    dead = F.col("attempts") >= max_retries
    return messages.drop("reason").join(nacks.select("queue", "id", "reason"), ["queue", "id"]).withColumn("state", F.when(dead, "dlq").otherwise("ready"))


def recovered(stored: DataFrame, as_of: Column) -> DataFrame:
    """The state of stored messages after a restart."""
    return stored.withColumn("state", F.when((F.col("visible_at") > as_of) & (F.col("attempts") > 0), "inflight").otherwise("ready"))


def counters(messages: DataFrame, dead: DataFrame) -> DataFrame:
    """queue, pending, inflight, dlq."""
    counted = lambda df, name, state: df.select("queue", F.lit(name).alias("kind")) if state is None else df.filter(F.col("state") == state).select("queue", F.lit(name).alias("kind"))
    rows = counted(messages, "pending", "ready").unionByName(counted(messages, "inflight", "inflight")).unionByName(counted(dead, "dlq", None))
    return rows.groupBy("queue").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("pending", "inflight", "dlq")])


def next_deadline(messages: DataFrame) -> DataFrame:
    """queue, deadline: the earliest of each queue's in-flight messages."""
    return messages.filter("state = 'inflight'").groupBy("queue").agg(F.min("visible_at").alias("deadline"))


def _searched(df: DataFrame, search: str | None) -> DataFrame:
    return df.filter(F.contains(pl.lossy(F.col("payload")), F.lit(search))) if search else df


def listing(messages: DataFrame, queue: str, state: str, search: str | None = None) -> DataFrame:
    """A queue's messages in a state (pending or inflight, any case; another gives none)."""
    wanted = {"pending": "ready", "inflight": "inflight"}.get(state.lower())
    return _searched(messages.filter((F.col("queue") == queue) & (F.lit(False) if wanted is None else F.col("state") == wanted)), search)


def message_page(messages: DataFrame, queue: str, state: str, search: str | None = None, offset: int = 0, limit: int = PAGE_DEFAULT, order: str = "enqueue_ord") -> DataFrame:
    """Pending: lowest priority first, then first in.  In flight: earliest deadline first."""
    by = [F.col("priority"), F.col(order)] if state.lower() == "pending" else [F.col("visible_at"), F.col(order)]
    return page(listing(messages, queue, state, search), by, offset, limit, QUEUE_PAGE_CAP)


def dlq_page(dead: DataFrame, queue: str, search: str | None = None, offset: int = 0, limit: int = PAGE_DEFAULT, order: str = "dlq_ord") -> DataFrame:
    """Newest failure first."""
    return page(_searched(dead.filter(F.col("queue") == queue), search), [F.col(order).desc()], offset, limit, QUEUE_PAGE_CAP)


def replayed(dead: DataFrame, ids: DataFrame) -> DataFrame:
    """Dead letters in ids(queue, id) as they return to the queue: attempts 0, no reason, ready."""
    return dead.join(ids.select("queue", "id"), ["queue", "id"], "left_semi").withColumn("attempts", F.lit(0)).withColumn("reason", F.lit(None).cast("string")).withColumn("state", F.lit("ready"))


def without_dead(dead: DataFrame, ids: DataFrame) -> DataFrame:
    return dead.join(ids.select("queue", "id"), ["queue", "id"], "left_anti")


def purge_counts(dead: DataFrame) -> DataFrame:
    return dead.groupBy("queue").agg(F.count(F.lit(1)).alias("purged"))


#: Entries of messages that moved on that lanes may hold besides half as many as there are ready messages.
STALE_LEAST = 1000


@dataclass
class QueueState:
    """One queue, folded op by op, each op in time that does not depend on how many messages are ready.

    A message is a tuple (id, priority, attempts, order, deadline or None, reason), a new one whenever it moves; a tuple
    in lanes or due that is no longer in messages is of a message that moved on, and is skipped.
    """

    visibility_ms: int = VISIBILITY_MS
    max_retries: int = MAX_RETRIES
    messages: dict = field(default_factory=dict)  # id -> message
    lanes: dict = field(default_factory=dict)  # priority -> deque of messages, first in first
    levels: list = field(default_factory=list)  # heap of -priority, of each lane
    dead: dict = field(default_factory=dict)  # id -> (priority, attempts, reason, failed at ms), in order of failure
    due: dict = field(default_factory=dict)  # deadline -> messages in flight
    deadlines: list = field(default_factory=list)  # heap of the keys of due
    order: int = 0
    ready: int = 0  # number of ready messages
    stale: int = 0  # entries of lanes that are skipped

    def _enqueue(self, id_: str | None, priority: int, attempts: int = 0, reason: str | None = None) -> None:
        """A new message, or one that goes to the tail; another with its id goes."""
        self.order += 1
        before = self.messages.get(id_)
        message = self.messages[id_] = (id_, priority, attempts, self.order, None, reason)
        lane = self.lanes.get(priority)
        if lane is None:
            lane = self.lanes[priority] = deque()
            heapq.heappush(self.levels, -priority)
        lane.append(message)
        self.ready += 1
        if before is not None:
            self._left(before)

    def _left(self, message: tuple) -> None:
        """message is no longer in messages; lanes are cleared of such entries when they are many, so that they take no space."""
        if message[4] is None:
            self.ready -= 1
            self.stale += 1
            if self.stale > self.ready // 2 + STALE_LEAST:
                for priority, lane in self.lanes.items():
                    self.lanes[priority] = deque(m for m in lane if self.messages.get(m[0]) is m)
                self.stale = 0

    def _fail(self, message: tuple, reason: str, now: int) -> None:
        id_, priority, attempts = message[:3]
        if attempts >= self.max_retries:
            del self.messages[id_]
            self._left(message)
            self.dead[id_] = (priority, attempts, reason, now)
        else:
            self._enqueue(id_, priority, attempts, reason)

    def _take(self, n: int, now: int) -> list[tuple[str, int]]:
        n = min(n, self.ready)
        if n <= 0:
            return []
        messages, out, deadline = self.messages, [], now + self.visibility_ms
        due = self.due.get(deadline)
        if due is None:
            due = self.due[deadline] = []
            heapq.heappush(self.deadlines, deadline)
        while len(out) < n:
            lane = self.lanes[-self.levels[0]]
            if not lane:
                del self.lanes[-heapq.heappop(self.levels)]
                continue
            message = lane.popleft()
            id_, priority, attempts, order, _, reason = message
            if messages.get(id_) is not message:
                self.stale -= 1
                continue
            attempts += 1
            message = messages[id_] = (id_, priority, attempts, order, deadline, reason)
            due.append(message)
            out.append((id_, attempts))
        self.ready -= n
        return out

    def waiting(self) -> Iterator[tuple]:
        """Ready messages in the order of dispatch."""
        return (m for priority in sorted(self.lanes, reverse=True) for m in self.lanes[priority] if self.messages.get(m[0]) is m)

    def flying(self) -> list[tuple]:
        """Messages in flight, by deadline."""
        return sorted((m for m in self.messages.values() if m[4] is not None), key=itemgetter(4, 3))

    def expire(self, now: int) -> None:
        while self.deadlines and self.deadlines[0] <= now:
            for message in sorted(self.due.pop(heapq.heappop(self.deadlines)), key=itemgetter(3)):
                if self.messages.get(message[0]) is message:
                    self._fail(message, TIMEOUT, now)

    def apply(self, op: str, now: int, id_: str | None = None, priority: int | None = None, max_n: int | None = None, reason: str | None = None) -> tuple[list[tuple[str, int]], bool]:
        """Deliveries (id, attempt), and whether the op had an effect."""
        if self.deadlines and self.deadlines[0] <= now:
            self.expire(now)
        if op == "push":
            self._enqueue(id_, priority or 0)
        elif op == "consume":
            most = CONSUME_BATCH if max_n is None else max_n
            out = self._take(most if most >= 0 else self.ready + most, now)
            return out, bool(out)
        elif op == "ack":
            message = self.messages.pop(id_, None)
            if message is None:
                return [], False
            self._left(message)
        elif op == "nack":
            message = self.messages.get(id_)
            if message is None:
                return [], False
            self._fail(message, reason or "", now)
        elif op == "dlq_replay":
            if id_ not in self.dead:
                return [], False
            self._enqueue(id_, self.dead.pop(id_)[0])
        elif op == "dlq_delete":
            return [], self.dead.pop(id_, None) is not None
        elif op == "dlq_purge":
            self.dead.clear()
        elif op == "delete":
            for held in (self.messages, self.lanes, self.levels, self.dead, self.due, self.deadlines):
                held.clear()
            self.ready = self.stale = 0
        else:
            return [], False
        return [], True


FOLDED = "queue string, op_seq long, op string, id string, attempt int, effect boolean, pending int, inflight int, dlq int"
STATES = "queue string, id string, state string, priority int, attempts int, reason string, place int"
#: Rows of a batch that a fold returns, or one op's deliveries if these are more.
BATCH_ROWS = 10_000


def _values(column) -> list:
    """Python values of an Arrow array, equal ones as one object."""
    import numpy as np

    coded = column.dictionary_encode()
    distinct = np.append(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), None)
    return distinct[coded.indices.fill_null(len(distinct) - 1).to_numpy(zero_copy_only=False)].tolist()


def _segments(batches, visibility_ms: int, max_retries: int) -> Iterator[tuple]:
    """For each batch of rows in order of queue and op_seq: the batch, and (queue, state, its rows there as (place, arguments of apply())); a queue has one state."""
    state = queue = None

    def segments(batch):
        nonlocal state, queue
        names, rows = _values(batch.column("queue")), enumerate(zip(*[_values(batch.column(c)) for c in ("op", "at_ms", "id", "priority", "max_n", "reason")], strict=True))
        timeouts, retries = [_values(batch.column(c)) if c in batch.schema.names else None for c in ("visibility_timeout_ms", "max_retries")]
        start = 0
        for name, run in groupby(names):
            if state is None or name != queue:
                timeout, most = [given and given[start] for given in (timeouts, retries)]
                queue, state = name, QueueState(timeout or visibility_ms, max_retries if most is None else most)
            n = sum(1 for _ in run)
            yield queue, state, islice(rows, n)
            start += n

    return ((batch, segments(batch)) for batch in batches)


def _timed(ops: DataFrame, config: DataFrame | None) -> DataFrame:
    out = ops.select("queue", F.col("op_seq").cast("long").alias("op_seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "op", "id", "priority", "max_n", "reason")
    return out if config is None else out.join(config.select("queue", "visibility_timeout_ms", "max_retries"), "queue", "left")


def _ordered(ops: DataFrame, config: DataFrame | None) -> DataFrame:
    """A queue's ops in one partition, in order: Spark sorts them, on disk if need be, and Python gets them batch by batch."""
    return _timed(ops, config).repartition("queue").sortWithinPartitions("queue", F.col("op_seq").asc_nulls_last())


def fold_queues(ops: DataFrame, config: DataFrame | None = None, visibility_ms: int = VISIBILITY_MS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """FOLDED: one row for each delivery, one for every other op, with the queue's counters after it.

    A retried message goes to the tail, so order depends on all that came before: a queue is folded by one task, over
    ids and numbers (payloads stay out); queues are independent.  A task holds the messages of one queue that are alive
    or dead, not its ops.
    """

    def fold(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]

        def table(batch, columns):
            source, *made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.select(["queue", "op_seq", "op"]).take(source).columns, *made], names=[x.split()[0] for x in FOLDED.split(", ")])

        for batch, segments in _segments(batches, visibility_ms, max_retries):
            columns = source, ids, attempts, effects, ready, flying, dead = [[] for _ in types]
            for _, state, rows in segments:
                apply, messages, gone = state.apply, state.messages, state.dead
                for k, op in rows:
                    out, effect = apply(*op)
                    for id_, attempt in out or ((op[2], None),):
                        source.append(k)
                        ids.append(id_)
                        attempts.append(attempt)
                        effects.append(effect)
                        ready.append(state.ready)
                        flying.append(len(messages) - state.ready)
                        dead.append(len(gone))
                    if len(source) >= BATCH_ROWS:
                        yield table(batch, columns)
                        for column in columns:
                            column.clear()
            if source:
                yield table(batch, columns)

    return _ordered(ops, config).mapInArrow(fold, FOLDED)


def queue_states(ops: DataFrame, config: DataFrame | None = None, visibility_ms: int = VISIBILITY_MS, max_retries: int = MAX_RETRIES, now_ms: int | None = None) -> DataFrame:
    """STATES: every message after the whole log (and timeouts up to now_ms); place is the order of dispatch, of deadline or of failure."""

    def end(queue, state):
        if now_ms is not None:
            state.expire(now_ms)
        living = [("ready", state.waiting()), ("inflight", state.flying())]
        yield from ((queue, i, kind, p, a, why, k) for kind, found in living for k, (i, p, a, _, _, why) in enumerate(found))
        yield from ((queue, i, "dlq", p, a, why, k) for k, (i, (p, a, why, _)) in enumerate(state.dead.items()))

    def ends(batches):
        last = None
        for _, segments in _segments(batches, visibility_ms, max_retries):
            for queue, state, rows in segments:
                if last is not None and last[1] is not state:
                    yield from end(*last)
                for _, op in rows:
                    state.apply(*op)
                last = queue, state
        if last is not None:
            yield from end(*last)

    def fold(batches):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        rows = ends(batches)
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=[x.split()[0] for x in STATES.split(", ")])

    return _ordered(ops, config).mapInArrow(fold, STATES)
