"""Topic routing: subscriptions, fan-out, retained values and their listings.

publishes(pub_seq, ts, topic, payload, retain, ttl_s); subscription ops(op_seq, ts, op, client_id, pattern).

Patterns are joined to topics by equality on one literal level (`anchor`), and only then by regular expression, over
the distinct topics.  So no join is nested-loop, and a message costs one equality join to its topic's clients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import patterns
from sluice.functions.common import PAGE_CAP, PAGE_DEFAULT, RETAINED_TTL_S, latest_by, page, plus_seconds


def subscriptions(ops: DataFrame) -> DataFrame:
    """client_id, pattern, since: live subscriptions after an op log of connect, sub, unsub and disconnect.

    A subscription made while its client was not connected has no effect, and a disconnect ends all of a client's.
    """
    gone = ops.filter("op = 'disconnect'").groupBy("client_id").agg(F.max("op_seq").alias("gone"))
    came = (
        ops.filter("op = 'connect'")
        .join(gone, "client_id", "left")
        .filter("gone is null or op_seq > gone")
        .groupBy("client_id")
        .agg(F.min("op_seq").alias("came"))
    )
    last = latest_by(ops.filter("op in ('sub', 'unsub')").select("client_id", "pattern", "op_seq", "op"), ["client_id", "pattern"], "op_seq")
    return last.filter("op = 'sub'").join(came, "client_id").filter("op_seq > came").select("client_id", "pattern", F.col("op_seq").alias("since"))


def connected(ops: DataFrame) -> DataFrame:
    """client_id of clients whose last connect or disconnect is a connect."""
    last = latest_by(ops.filter("op in ('connect', 'disconnect')").select("client_id", "op_seq", "op"), ["client_id"], "op_seq")
    return last.filter("op = 'connect'").select("client_id")


def without_clients(subs: DataFrame, gone: DataFrame) -> DataFrame:
    """Subscriptions after the clients in gone(client_id) have left."""
    return subs.join(gone.select("client_id"), "client_id", "left_anti")


def matched(topics: DataFrame, subs: DataFrame, topic: str = "topic") -> DataFrame:
    """topics(topic) x subs(pattern, ...) where the pattern matches: topic and the columns of subs, each pair once."""
    keyed = topics.select(topic).distinct().withColumn("_k", F.explode(patterns.anchors(F.col(topic)))).select(topic, F.col("_k.level").alias("_level"), F.col("_k.token").alias("_token"))
    own = subs.select("pattern").distinct().select("pattern", patterns.regex(F.col("pattern")).alias("_regex"), patterns.anchor(F.col("pattern")).alias("_k"))
    own = own.select("pattern", "_regex", F.col("_k.level").alias("_level"), F.col("_k.token").alias("_token"))
    pairs = keyed.join(own, ["_level", "_token"]).filter(F.rlike(F.col(topic), F.col("_regex"))).select(topic, "pattern")
    return pairs.join(subs, "pattern")


class TopicRouter:
    def __init__(self, publishes: DataFrame, subs: DataFrame):
        self.publishes, self.subs = publishes, subs.select("client_id", "pattern").distinct()

    def per_pattern(self) -> DataFrame:
        """pub_seq, topic, client_id, pattern: one row for each matching subscription, as client-side dispatch sees it."""
        return self.publishes.select("pub_seq", "topic").join(matched(self.publishes, self.subs), "topic").select("pub_seq", "topic", "client_id", "pattern")

    def deliveries(self) -> DataFrame:
        """pub_seq, topic, client_id: each client once for a message, however many of its patterns match."""
        clients = matched(self.publishes, self.subs).select("topic", "client_id").distinct()
        return self.publishes.select("pub_seq", "topic").join(clients, "topic").select("pub_seq", "topic", "client_id")

    def counts(self) -> DataFrame:
        """pub_seq, topic, delivered: clients reached by each message, 0 included."""
        clients = matched(self.publishes, self.subs).groupBy("topic").agg(F.countDistinct("client_id").alias("delivered"))
        return self.publishes.select("pub_seq", "topic").join(clients, "topic", "left").select("pub_seq", "topic", F.coalesce("delivered", F.lit(0)).cast("long").alias("delivered"))


class Retained:
    """The last retained value of each topic.  A null payload, or a tag without content, clears; a ttl of 0 expires at once."""

    def __init__(self, publishes: DataFrame, default_ttl_s: int = RETAINED_TTL_S):
        self.publishes, self.default_ttl_s = publishes, default_ttl_s

    def held(self) -> DataFrame:
        """topic, payload, expires_at, pub_seq: expired ones too."""
        expires = plus_seconds(F.col("ts"), F.coalesce("ttl_s", F.lit(self.default_ttl_s)))
        last = latest_by(self.publishes.filter("retain").select("topic", "pub_seq", "payload", expires.alias("expires_at")), ["topic"], "pub_seq")
        return last.filter(F.coalesce(F.octet_length("payload"), F.lit(0)) > 1)

    def live(self, as_of: Column) -> DataFrame:
        return self.held().filter(F.col("expires_at").isNull() | (as_of < F.col("expires_at")))

    def replay(self, subs: DataFrame, as_of: Column) -> DataFrame:
        """client_id, pattern, topic, payload: what each new subscription gets at once."""
        live = self.live(as_of).select("topic", "payload")
        return matched(live, subs.select("client_id", "pattern").distinct()).join(live, "topic").select("client_id", "pattern", "topic", "payload")


def topics(subs: DataFrame, retained: Retained, as_of: Column, search: str | None = None) -> DataFrame:
    """path, subscribers, payload: every pattern with subscribers and every topic with a value; the payload is null once expired."""
    counted = subs.groupBy(F.col("pattern").alias("path")).agg(F.countDistinct("client_id").alias("subscribers"))
    held = retained.held().select(F.col("topic").alias("path"), F.when(F.col("expires_at").isNull() | (as_of < F.col("expires_at")), F.col("payload")).alias("payload"))
    out = counted.join(held, "path", "full_outer").select("path", F.coalesce("subscribers", F.lit(0)).cast("long").alias("subscribers"), "payload")
    return out.filter(F.contains("path", F.lit(search))) if search else out


def topic_page(subs: DataFrame, retained: Retained, as_of: Column, search: str | None = None, offset: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    return page(topics(subs, retained, as_of, search), [F.col("path")], offset, limit, PAGE_CAP)


def wildcard_subscriptions(subs: DataFrame, search: str | None = None) -> DataFrame:
    """pattern, kind multi|single, subscribers."""
    out = subs.withColumn("kind", patterns.listing_kind(F.col("pattern"))).filter("kind is not null")
    out = out.filter(F.contains("pattern", F.lit(search))) if search else out
    return out.groupBy("pattern", "kind").agg(F.countDistinct("client_id").alias("subscribers"))


def active_clients(ops: DataFrame) -> DataFrame:
    return connected(ops).agg(F.count(F.lit(1)).alias("clients"))
