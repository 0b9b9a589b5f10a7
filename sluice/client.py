"""The four subsystems behind method calls, for applications: every call appends to an op log, every answer is a fold of it.

    client = Client(spark, "/data/events")
    client.store.set("user:7", {"name": "Ann"}, ttl=60)
    client.queue("mail").push("hello", priority=5)

A client is the only writer of its root.  Calls are for control and small traffic; bulk traffic goes through the
operators over whole op logs (`client.ops(...)` gives them), which these calls use as well.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.common import CONSUME_BATCH, KV_PAGE_DEFAULT, MAX_PAYLOAD, MAX_RETRIES, PAGE_DEFAULT, VISIBILITY_MS, at, checked_name
from sluice.operators import groups, router, workqueue
from sluice.operators.eventlog import EventLog
from sluice.operators.kv import KvTable
from sluice.operators.router import Retained, TopicRouter

SCHEMAS = {
    "kv": "op_seq long, ts timestamp_ntz, op string, key string, payload binary, ttl_s long",
    "publishes": "pub_seq long, ts timestamp_ntz, topic string, payload binary, retain boolean, ttl_s long",
    "subscriptions": "op_seq long, ts timestamp_ntz, op string, client_id string, pattern string",
    "queue": "op_seq long, ts timestamp_ntz, queue string, op string, id string, payload binary, priority int, max_n int, reason string",
    "queue_config": "op_seq long, queue string, op string, visibility_timeout_ms long, max_retries int",
    "log": "op_seq long, topic string, seq long, ts timestamp_ntz, payload binary",
    "log_config": "op_seq long, topic string, op string, max_ack_pending int, ack_wait_ms long, max_deliveries int",
    "groups": "topic string, group_id string, op_seq long, ts timestamp_ntz, op string, consumer_id string, generation long, seq long, max_n int",
}


class Missing(KeyError):
    """A queue or topic that doesn't exist."""


class Rejected(RuntimeError):
    """FENCED, NOT_MEMBER, NOT_OWNER or NOT_PENDING."""


def encode(value: Any) -> bytes:
    """Bytes as raw, text as text, everything else as JSON."""
    if isinstance(value, (bytes, bytearray)):
        out = b"\x00" + bytes(value)
    elif isinstance(value, str):
        out = b"\x01" + value.encode()
    else:
        out = b"\x02" + json.dumps(value, ensure_ascii=False).encode()
    if len(out) > MAX_PAYLOAD:
        raise ValueError("payload too large")
    return out


def decode(payload: bytes | None) -> Any:
    """The value behind a payload: empty JSON is None, an unknown tag gives the bytes."""
    if not payload:
        return None
    tag, content = payload[0], bytes(payload[1:])
    if tag == 1:
        return content.decode("utf-8", "replace")
    if tag == 2:
        return json.loads(content) if content else None
    return content if tag == 0 else bytes(payload)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Client:
    """clock and ids are parameters, so that a run can be repeated exactly."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] = utc_now, new_id: Callable[[], str] = lambda: str(uuid.uuid4())):
        self.spark, self.root, self.clock, self.new_id = spark, root.rstrip("/"), clock, new_id
        self.last = max((self.ops(k).agg(F.max("pub_seq" if k == "publishes" else "op_seq")).first()[0] or 0 for k in SCHEMAS), default=0)
        self.store, self.pubsub = Store(self), PubSub(self)

    def queue(self, name: str) -> Queue:
        return Queue(self, checked_name(name))

    def stream(self, topic: str) -> Stream:
        return Stream(self, checked_name(topic))

    def ops(self, kind: str) -> DataFrame:
        """An op log so far."""
        try:
            return self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.root}/{kind}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMAS[kind])

    def append(self, kind: str, *rows: dict) -> int:
        """Append ops; gives the last one's number."""
        fields = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
        full, now = [], self.clock()
        for row in rows:
            self.last += 1
            full.append(tuple({"op_seq": self.last, "pub_seq": self.last, "ts": now, **row}.get(f) for f in fields))
        self.spark.createDataFrame(full, SCHEMAS[kind]).coalesce(1).write.mode("append").parquet(f"{self.root}/{kind}")
        return self.last

    def now(self):
        return at(self.clock())


class Store:
    def __init__(self, client: Client):
        self.client = client

    @property
    def table(self) -> KvTable:
        return KvTable(self.client.ops("kv"))

    def set(self, key: str, value: Any, ttl: int | None = None) -> None:
        self.client.append("kv", {"op": "set", "key": key, "payload": encode(value), "ttl_s": ttl})

    def get(self, key: str) -> Any:
        row = self.table.live(self.client.now()).filter(F.col("key") == key).first()
        return decode(row.payload) if row else None

    def delete(self, key: str) -> None:
        self.client.append("kv", {"op": "del", "key": key})

    def page(self, search: str | None = None, offset: int = 0, limit: int = KV_PAGE_DEFAULT) -> DataFrame:
        return self.table.scan(self.client.now(), search, offset, limit)


class PubSub:
    def __init__(self, client: Client):
        self.client = client

    @property
    def subscriptions(self) -> DataFrame:
        return router.subscriptions(self.client.ops("subscriptions"))

    @property
    def retained(self) -> Retained:
        return Retained(self.client.ops("publishes"))

    def connect(self, client_id: str) -> None:
        self.client.append("subscriptions", {"op": "connect", "client_id": client_id})

    def disconnect(self, client_id: str) -> None:
        self.client.append("subscriptions", {"op": "disconnect", "client_id": client_id})

    def subscribe(self, client_id: str, pattern: str) -> DataFrame:
        """Subscribes, and gives the retained values that match: topic, payload."""
        self.client.append("subscriptions", {"op": "sub", "client_id": client_id, "pattern": pattern})
        own = self.subscriptions.filter((F.col("client_id") == client_id) & (F.col("pattern") == pattern))
        return self.retained.replay(own, self.client.now()).select("topic", "payload")

    def unsubscribe(self, client_id: str, pattern: str) -> None:
        self.client.append("subscriptions", {"op": "unsub", "client_id": client_id, "pattern": pattern})

    def publish(self, topic: str, value: Any, retain: bool = False, ttl: int | None = None) -> int:
        """Publishes; gives the number of clients reached.  A value of None with retain clears the topic."""
        payload = None if value is None and retain else encode(value)
        seq = self.client.append("publishes", {"topic": topic, "payload": payload, "retain": retain, "ttl_s": ttl})
        return TopicRouter(self.client.ops("publishes").filter(F.col("pub_seq") == seq), self.subscriptions).counts().first().delivered

    def page(self, search: str | None = None, offset: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
        return router.topic_page(self.subscriptions, self.retained, self.client.now(), search, offset, limit)


class Queue:
    def __init__(self, client: Client, name: str):
        self.client, self.name, self.dlq = client, name, DeadLetters(self)

    def create(self, visibility_timeout_ms: int = VISIBILITY_MS, max_retries: int = MAX_RETRIES) -> None:
        """Idempotent: an existing queue keeps its configuration."""
        if not self.exists():
            self.client.append("queue_config", {"queue": self.name, "op": "create", "visibility_timeout_ms": visibility_timeout_ms, "max_retries": max_retries})

    def _config_ops(self) -> DataFrame:
        return self.client.ops("queue_config").filter(F.col("queue") == self.name)

    def exists(self) -> bool:
        return not workqueue.existing(self._config_ops()).isEmpty()

    def delete(self) -> None:
        self._checked()
        self.client.append("queue_config", {"queue": self.name, "op": "delete"})
        self._do("delete")

    def _checked(self) -> DataFrame:
        ops = self._config_ops()
        last = ops.orderBy(F.col("op_seq").desc()).first()
        if last is None or last.op != "create":
            raise Missing(self.name)
        return ops.filter(F.col("op_seq") == last.op_seq)

    def _do(self, op: str, **values: Any) -> int:
        return self.client.append("queue", {"queue": self.name, "op": op, **values})

    @property
    def ops(self) -> DataFrame:
        return self.client.ops("queue").filter(F.col("queue") == self.name)

    def _fold(self, seq: int) -> DataFrame:
        return workqueue.fold_queues(self.ops, self._config()).filter(F.col("op_seq") == seq)

    def _config(self) -> DataFrame:
        return self._checked().select("queue", "visibility_timeout_ms", "max_retries")

    def push(self, value: Any, priority: int = 0) -> str:
        self._checked()
        if not 0 <= priority <= 255:
            raise ValueError("priority is 0 to 255")
        id_ = self.client.new_id()
        self._do("push", id=id_, payload=encode(value), priority=priority)
        return id_

    def consume(self, n: int = CONSUME_BATCH) -> list[tuple[str, Any, int]]:
        """(id, value, attempt) of at most n messages, highest priority first."""
        self._checked()
        seq = self._do("consume", max_n=n)
        taken = [(r.id, r.attempt) for r in self._fold(seq).filter("attempt is not null").collect()]  # at most n
        values = {r.id: r.payload for r in self.ops.filter((F.col("op") == "push") & F.col("id").isin([i for i, _ in taken])).collect()} if taken else {}
        return [(i, decode(values[i]), attempt) for i, attempt in taken]

    def _effect(self, op: str, **values: Any) -> bool:
        self._checked()
        return self._fold(self._do(op, **values)).first().effect

    def ack(self, id_: str) -> bool:
        return self._effect("ack", id=id_)

    def nack(self, id_: str, reason: str = "") -> bool:
        return self._effect("nack", id=id_, reason=reason)

    def states(self) -> DataFrame:
        now = int(self.client.clock().replace(tzinfo=timezone.utc).timestamp() * 1000)
        return workqueue.queue_states(self.ops, self._config(), now_ms=now)

    def work(self, handle: Callable[[Any], None], n: int = CONSUME_BATCH, concurrency: int = 5) -> int:
        """One batch through a handler: acknowledged if it returns, rejected with its error if it raises.  Gives the batch's size."""
        batch = self.consume(n)

        def attempt(value: Any) -> str | None:
            try:
                handle(value)
            except Exception as error:  # noqa: BLE001  whatever a handler raises is the message's failure
                return str(error)
            return None

        with ThreadPoolExecutor(concurrency) as pool:
            errors = list(pool.map(attempt, [value for _, value, _ in batch]))
        done = [{"queue": self.name, "op": "ack" if e is None else "nack", "id": i, "reason": e} for (i, _, _), e in zip(batch, errors, strict=True)]
        if done:
            self.client.append("queue", *done)
        return len(batch)


class DeadLetters:
    def __init__(self, queue: Queue):
        self.queue = queue

    def peek(self, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
        """Newest failure first: id, priority, attempts, reason."""
        dead = self.queue.states().filter("state = 'dlq'")
        return workqueue.dlq_page(dead, self.queue.name, None, offset, limit, "place").select("id", "priority", "attempts", "reason")

    def move_to_queue(self, id_: str) -> bool:
        return self.queue._effect("dlq_replay", id=id_)

    def delete(self, id_: str) -> bool:
        return self.queue._effect("dlq_delete", id=id_)

    def purge(self) -> int:
        n = self.queue.states().filter("state = 'dlq'").count()
        self.queue._do("dlq_purge")
        return n


class Stream:
    def __init__(self, client: Client, topic: str):
        self.client, self.topic = client, topic

    def create(self, max_ack_pending: int = groups.MAX_ACK_PENDING, ack_wait_ms: int = groups.ACK_WAIT_MS, max_deliveries: int = groups.MAX_DELIVERIES) -> None:
        if not self.exists():
            self.client.append("log_config", {"topic": self.topic, "op": "create", "max_ack_pending": max_ack_pending, "ack_wait_ms": ack_wait_ms, "max_deliveries": max_deliveries})

    def _config(self):
        return self.client.ops("log_config").filter(F.col("topic") == self.topic).orderBy(F.col("op_seq").desc()).first()

    def exists(self) -> bool:
        last = self._config()
        return last is not None and last.op == "create"

    def delete(self) -> None:
        """Ends the topic: its rows and its groups' ops stay in the op logs, but only what follows a new create() counts."""
        self._checked()
        self.client.append("log_config", {"topic": self.topic, "op": "delete"})

    def _checked(self):
        last = self._config()
        if last is None or last.op != "create":
            raise Missing(self.topic)
        return last

    def _since_create(self, kind: str) -> DataFrame:
        """The topic's ops since it was last created; none while it does not exist."""
        last = self._config()
        begin = F.lit(last.op_seq) if last is not None and last.op == "create" else F.lit(None)
        return self.client.ops(kind).filter((F.col("topic") == self.topic) & (F.col("op_seq") > begin))

    @property
    def log(self) -> EventLog:
        return EventLog(self._since_create("log"))

    def last_seq(self) -> int:
        row = self.log.last().first()
        return row.last_seq if row else 0

    def publish(self, *values: Any) -> int:
        """Appends; gives the last seq."""
        self._checked()
        seq = self.last_seq()
        self.client.append("log", *({"topic": self.topic, "seq": seq + i, "payload": encode(v)} for i, v in enumerate(values, 1)))
        return seq + len(values)

    def read(self, start: int = 1, limit: int = PAGE_DEFAULT) -> DataFrame:
        return self.log.read(self.topic, start, limit)

    def tail(self, limit: int = PAGE_DEFAULT) -> DataFrame:
        return self.log.tail(self.topic, limit)

    def group(self, name: str) -> Group:
        return Group(self, checked_name(name))


class Group:
    """A consumer group of a topic."""

    def __init__(self, stream: Stream, name: str):
        self.stream, self.name = stream, name

    def _do(self, op: str, **values: Any) -> list:
        config = self.stream._checked()
        client, key = self.stream.client, {"topic": self.stream.topic, "group_id": self.name}
        seq = client.append("groups", {**key, "op": op, **values})
        own = self.stream._since_create("groups").filter(F.col("group_id") == self.name)
        bounds = client.spark.createDataFrame([(self.stream.topic, 1, self.stream.last_seq())], "topic string, head_seq long, last_seq long")
        limits = {k: config[k] for k in ("max_ack_pending", "ack_wait_ms", "max_deliveries")}
        rows = groups.fold_groups(own, bounds, **limits).filter(F.col("op_seq") == seq).collect()  # one call's rows
        if rows[0].rejected:
            raise Rejected(rows[0].rejected)
        return rows

    def join(self, consumer: str) -> int:
        """Gives the generation, which fetch and ack carry."""
        return self._do("join", consumer_id=consumer)[0].generation

    def leave(self, consumer: str, generation: int = 1) -> None:
        self._do("leave", consumer_id=consumer, generation=generation)

    def fetch(self, consumer: str, generation: int = 1, n: int = CONSUME_BATCH) -> list[tuple[int, Any, int]]:
        """(seq, value, attempt) of at most n rows: redeliveries first."""
        taken = [(r.seq, r.attempt) for r in self._do("fetch", consumer_id=consumer, generation=generation, max_n=n) if r.attempt is not None]
        if not taken:
            return []
        values = {r.seq: r.payload for r in self.stream.log.log.filter(F.col("seq").isin([s for s, _ in taken])).collect()}
        return [(s, decode(values[s]), attempt) for s, attempt in taken]

    def work(self, handler: Callable[[Any], Any], consumer: str, generation: int = 1, n: int = CONSUME_BATCH) -> int:
        """Fetches once and acknowledges what the handler takes; what it raises on stays pending until its time is up.  Gives the rows fetched."""
        rows = self.fetch(consumer, generation, n)
        for seq, value, _ in rows:
            try:
                handler(value)
            except Exception:  # redelivered once the acknowledgement is overdue
                continue
            self.ack(consumer, seq, generation)
        return len(rows)

    def ack(self, consumer: str, seq: int, generation: int = 1) -> int:
        """Gives the floor after it."""
        return self._do("ack", consumer_id=consumer, generation=generation, seq=seq)[0].ack_floor

    def seek(self, target: str) -> int:
        """beginning or end; gives the new generation, and earlier consumers are fenced."""
        if target not in ("beginning", "end"):
            raise ValueError("target is beginning or end")
        return self._do(f"seek_{target}")[0].generation
