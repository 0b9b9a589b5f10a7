"""The method-call surface, end to end."""

from datetime import datetime, timedelta

import pytest

from sluice.client import Client, Missing, Rejected, decode, encode


class Clock:
    def __init__(self):
        self.time = datetime(2024, 1, 1)

    def __call__(self):
        return self.time

    def pass_(self, seconds):
        self.time += timedelta(seconds=seconds)


@pytest.fixture
def client(spark, tmp_path):
    ids = iter(range(1000))
    client = Client(spark, str(tmp_path / "root"), Clock(), lambda: f"m{next(ids)}")
    client.pass_ = client.clock.pass_
    return client


@pytest.mark.parametrize("value", [b"\x00\xff", "", "é", None, {"a": {"b": [1, "ü"]}}, 3.5, [], True])
def test_values_survive(value):
    assert decode(encode(value)) == value


def test_store(client):
    client.store.set("a", {"x": 1}, ttl=5)
    client.store.set("b", "text")
    assert client.store.get("a") == {"x": 1} and client.store.get("none") is None
    client.pass_(6)
    assert client.store.get("a") is None and [r.key for r in client.store.page().collect()] == ["b"]
    client.store.delete("b")
    assert client.store.get("b") is None


def test_pubsub(client):
    client.pubsub.connect("c")
    client.pubsub.connect("d")
    client.pubsub.subscribe("c", "s/+/t")
    client.pubsub.subscribe("c", "s/#")
    client.pubsub.subscribe("d", "#")
    assert client.pubsub.publish("s/k/t", 1, retain=True) == 2
    assert [(r.topic, decode(r.payload)) for r in client.pubsub.subscribe("d", "s/k/+").collect()] == [("s/k/t", 1)]
    client.pubsub.unsubscribe("d", "#")
    client.pubsub.disconnect("c")
    assert client.pubsub.publish("other", 2) == 0
    client.pubsub.publish("s/k/t", None, retain=True)
    assert client.pubsub.subscribe("d", "s/#").collect() == []


def test_queue(client):
    q = client.queue("mail")
    with pytest.raises(Missing):
        q.push("x")
    q.create(visibility_timeout_ms=1000, max_retries=2)
    q.create(max_retries=9)
    low, high = q.push("low"), q.push({"v": 1}, priority=9)
    assert q.consume(1) == [(high, {"v": 1}, 1)]
    assert q.ack(high) and not q.ack(high)
    assert q.consume() == [(low, "low", 1)] and q.nack(low, "no") and q.consume() == [(low, "low", 2)]
    client.pass_(2)
    assert [tuple(r) for r in q.dlq.peek().collect()] == [(low, 0, 2, "Timeout")]
    assert q.dlq.move_to_queue(low) and q.consume() == [(low, "low", 1)]
    assert q.dlq.purge() == 0
    q.delete()
    assert not q.exists()


def test_worker_loop(client):
    q = client.queue("jobs")
    q.create(max_retries=1)
    for i in range(4):
        q.push(i)

    def handle(value):
        if value == 2:
            raise RuntimeError("two")

    assert q.work(handle) == 4 and q.work(handle) == 0
    assert [r.reason for r in q.dlq.peek().collect()] == ["two"]


def test_stream(client, spark):
    s = client.stream("t")
    with pytest.raises(Missing):
        s.publish("x")
    s.create(max_deliveries=2)
    assert s.publish("a", "b", "c") == 3
    g = s.group("g")
    assert g.join("w") == 1 and g.fetch("w", n=2) == [(1, "a", 1), (2, "b", 1)]
    assert g.ack("w", 2) == 0 and g.ack("w", 1) == 2
    with pytest.raises(Rejected, match="NOT_PENDING"):
        g.ack("w", 1)
    assert g.seek("beginning") == 2
    with pytest.raises(Rejected, match="FENCED"):
        g.fetch("w")
    g.join("w")
    assert [v for _, v, _ in g.fetch("w", 2)] == ["a", "b", "c"]
    assert [decode(r.payload) for r in s.tail(2).collect()] == ["c", "b"]
    again = Client(spark, client.root, client.clock)
    assert again.last == client.last and again.stream("t").last_seq() == 3
    s.delete()
    assert not s.exists() and s.read().count() == 0 and s.tail().count() == 0
    with pytest.raises(Missing):
        s.publish("lost")
    s.create()
    assert s.read().count() == 0 and s.publish("d") == 1
    assert g.join("w") == 1 and g.fetch("w") == [(1, "d", 1)]


def test_group_worker(client, spark):
    s = client.stream("jobs")
    s.create()
    s.publish(1, 2, 3)
    g, seen = s.group("g"), []
    g.join("w")
    assert g.work(lambda x: seen.append(10 // (x - 2)), "w") == 3 and seen == [-10, 10]
    with pytest.raises(Rejected, match="NOT_PENDING"):
        g.ack("w", 1)
    assert g.ack("w", 2) == 3
