"""The driver's query catalogue for the event-data operators, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import payload as pl
from sluice.functions.common import at, page
from sluice.operators import eventlog, groups, router, workqueue
from sluice.operators.eventlog import EventLog
from sluice.operators.kv import KvTable, rendered_expiry
from sluice.operators.router import Retained, TopicRouter
from sluice.sources import tables

AS_OF = "2024-01-31 00:00:00"
RETAINED_AS_OF = "2024-01-15 12:00:00"
QUEUE_AS_OF = "1997-01-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL that several oracles begin with.
LOG = """with log as (select event_type as topic, row_number() over (partition by event_type order by ts, event_id) as seq,
 ts, props, event_id from events)"""
KV = """with ops as (select event_id as op_seq, ts, case when event_type = 'error' then 'del' else 'set' end as op, 'user:' || user_id as key, props,
 case event_type when 'purchase' then 864000 when 'view' then 172800 else 3600 end as ttl from events),
 ranked as (select *, row_number() over (partition by key order by op_seq desc) as r from ops where ts <= timestamp '2024-01-31 00:00:00'),
 live as (select key, props, ts + to_seconds(ttl) as expires_at from ranked where r = 1 and op = 'set' and timestamp '2024-01-31 00:00:00' <= ts + to_seconds(ttl))"""
SUBS = """subs0 as (select 'c' || n_nationkey as client_id, n_nationkey as k, case n_regionkey when 0 then 'evt/#' when 1 then 'evt/+/u' || (n_nationkey % 10) when 2 then 'evt/purchase/+'
 when 3 then 'evt/error/u3' else '#' end as pattern from nation),
 subs as (select client_id, pattern from subs0 where k % 7 <> 5 and k % 9 <> 8 union select 'c0', 'evt/purchase/u1')"""
PUBS = """pubs as (select event_id as pub_seq, ts, 'evt/' || event_type || '/u' || (user_id % 10) as topic, props, event_id % 5 = 0 as retain from events)"""
MATCH = """toks as (select distinct topic, string_split(topic, '/') as t from pubs),
 pats as (select distinct pattern, case when list_contains(string_split(pattern, '/'), '#') then list_slice(string_split(pattern, '/'), 1, list_position(string_split(pattern, '/'), '#') - 1)
 else string_split(pattern, '/') end as p, list_contains(string_split(pattern, '/'), '#') as multi from subs),
 matched as (select topic, pattern from toks, pats where (case when multi then len(t) >= len(p) else len(t) = len(p) end)
 and len(list_filter(range(1, len(p) + 1), lambda i: not (p[i] = '+' or p[i] = t[i]))) = 0)"""
HELD = """ret as (select topic, props, ts + interval 3600 second as expires_at, row_number() over (partition by topic order by pub_seq desc) as r from pubs where retain),
 held as (select topic, props, expires_at from ret where r = 1)"""
MSGS = """with msgs as (select o_orderstatus as queue, o_orderkey as id, cast(5 - cast(substr(o_orderpriority, 1, 1) as int) as bigint) as priority, o_orderdate as created_at, o_orderkey % 8 as failures,
 case when o_orderkey % 3 = 0 then o_orderkey % 8 else 0 end as attempts, case when o_orderkey % 3 = 0 then o_orderdate + interval 30 second else o_orderdate end as visible_at,
 case when o_orderkey % 3 = 0 then 'inflight' else 'ready' end as state, '{"o":' || o_orderkey || ',"c":' || o_custkey || '}' as body from orders)"""
DELIVERIES = LOG + """, dels as (select topic, g.group_id, seq, ts as delivered_at, 1 + event_id % 6 as deliveries,
 case when g.group_id = 'g1' then event_id % 1009 <> 500 else event_id % 211 <> 100 end as acked from log, (values ('g1'), ('g2')) g(group_id)),
 floors as (select topic, group_id, coalesce(min(seq) filter (where not (acked or deliveries >= 5)), max(seq) + 1) - 1 as ack_floor from dels group by all)"""
FETCHES = """fetches as (select distinct event_type as topic, g.group_id, o.ord as fetch_ord, 'w' || (o.ord % 3) as consumer_id, 10 + 7 * o.ord as max_n
 from events, (values ('g1'), ('g2')) g(group_id), range(1, 7) o(ord)),
 ranges as (select *, sum(max_n) over (partition by topic, group_id order by fetch_ord) as hi from fetches)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _text(column: str = "payload", name: str = "body") -> Column:
    return pl.text(F.col(column)).alias(name)


# Log


@query(LOG + " select topic, seq, event_id, props as body from log")
def log_seq(spark, sf_dir):
    """Sequence numbers by topic."""
    return tables.log(spark, sf_dir).select("topic", "seq", "event_id", _text())


@query(LOG + " select topic, seq, ts, props as body from log where topic = 'purchase' and seq >= 100 order by seq limit 50")
def log_range(spark, sf_dir):
    return EventLog(tables.log(spark, sf_dir)).read("purchase", 100, 50).select("topic", "seq", "ts", _text())


@query(LOG + " select topic, seq, ts, props as body from log where topic = 'view' order by seq desc limit 50")
def log_tail(spark, sf_dir):
    return EventLog(tables.log(spark, sf_dir)).tail("view").select("topic", "seq", "ts", _text())


@query(DELIVERIES + """, p as (select topic, group_id, count(*) filter (where not acked and deliveries < 5) as pending from dels group by all),
 l as (select topic, max(seq) as last_seq from log group by topic)
 select l.topic, last_seq, group_id, ack_floor, pending from l join floors using (topic) join p using (topic, group_id)""")
def log_snapshot(spark, sf_dir):
    """Last seq of each topic, and floor and pending count of its groups."""
    dels = tables.deliveries(spark, sf_dir)
    state = dels.groupBy(*groups.KEY).agg(F.count_if(~F.col("acked") & (F.col("deliveries") < 5)).alias("pending")).join(groups.floors(dels), groups.KEY)
    return EventLog(tables.log(spark, sf_dir)).snapshot(state)


@query(LOG + """ select topic, cast(floor((seq - 1) / 100) as bigint) as segment, min(seq) as start_seq, count(*) as rows, cast(sum(25 + strlen(props)) as bigint) as bytes,
 max(ts) as newest from log group by 1, 2""")
def log_segments(spark, sf_dir):
    return EventLog(tables.log(spark, sf_dir)).segments(100)


@query(LOG + """, seg as (select topic, cast(floor((seq - 1) / 100) as bigint) as segment, min(seq) as start_seq, sum(25 + strlen(props)) as bytes, max(ts) as newest from log group by 1, 2),
 cum as (select *, sum(bytes) over (partition by topic order by segment desc) as upto, row_number() over (partition by topic order by segment desc) as place from seg)
 select topic, min(start_seq) as head_seq, count(*) as segments, cast(sum(bytes) as bigint) as bytes from cum
 where place = 1 or (upto <= 40000 and newest >= timestamp '2024-01-11 00:00:00') group by topic""")
def log_retention(spark, sf_dir):
    """Segments within 40 000 bytes and 20 days, and the new head."""
    kept = eventlog.retained_segments(EventLog(tables.log(spark, sf_dir)).segments(100), at(AS_OF), 40_000, 20 * 24 * 3600 * 1000)
    return eventlog.heads(kept).join(kept.groupBy("topic").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes")), "topic")


# CRC-32 by hex digits: a table of 16, the low digit of a byte first.
@query(LOG + """, crc as (select list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as digits),
 bytes as (select topic, seq, printf('%016X', seq) || printf('%016X', epoch_us(ts) // 1000) || '02' || hex(props) as h from log),
 digits as (select topic, seq, list_transform(range(0, strlen(h)), lambda i: cast(instr('0123456789ABCDEF', substr(h, case when i % 2 = 0 then i + 2 else i end, 1)) - 1 as bigint)) as d from bytes)
 select topic, seq, xor(list_reduce(list_prepend(cast(4294967295 as bigint), d), lambda c, x: xor(c >> 4, crc.digits[(xor(c, x) & 15) + 1])), 4294967295) as crc from digits, crc""")
def log_crc(spark, sf_dir):
    """Record checksums."""
    return tables.log(spark, sf_dir).select("topic", "seq", eventlog.checksum(F.col("seq"), F.col("ts"), F.col("payload")).alias("crc"))


@query(LOG + " select topic, max(seq) + 1 as next_seq from log group by topic")
def log_next_seq(spark, sf_dir):
    return eventlog.next_seq(tables.log(spark, sf_dir))


@query(LOG.replace("with log", "with recursive log", 1) + """, c as materialized (select topic, seq, sum(25 + strlen(props)) over (partition by topic order by seq) as upto, 25 + strlen(props) as own from log),
 b as (select topic, seq, upto - own as base from c where seq = 1
  union all select n.topic, n.seq, c.upto - c.own from (select b.topic, min(c.seq) as seq from b join c on b.topic = c.topic and c.seq > b.seq and c.upto - b.base > 4096 group by b.topic) n join c using (topic, seq))
 select topic, seq as segment, coalesce(lead(seq) over (partition by topic order by seq), (select max(seq) from c where c.topic = b.topic) + 1) - seq as rows from b""")
def log_rolled(spark, sf_dir):
    """Exact greedy segment rolling at 4096 bytes: each boundary follows from the one before."""
    return EventLog(tables.log(spark, sf_dir)).rolled(4096).groupBy("topic", "segment").agg(F.count(F.lit(1)).alias("rows"))


# Consumer groups


@query(DELIVERIES + " select topic, group_id, ack_floor from floors")
def group_floor(spark, sf_dir):
    return groups.floors(tables.deliveries(spark, sf_dir))


def _fetches(spark, sf_dir):
    ord_ = F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ord")
    base = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    rows = base.select("topic", F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("group_id")).select("*", ord_)
    return rows.select("topic", "group_id", _long("ord"), F.concat(F.lit("w"), (F.col("ord") % 3).cast("string")).alias("consumer_id"), (10 + 7 * F.col("ord")).cast("long").alias("max_n")).withColumnRenamed("ord", "fetch_ord")


@query(LOG + ", " + FETCHES + " select r.topic, group_id, consumer_id, fetch_ord, seq from ranges r join log l on r.topic = l.topic and seq > hi - max_n and seq <= hi")
def group_assign(spark, sf_dir):
    """Each seq goes to one consumer of a group."""
    return groups.assign(tables.log(spark, sf_dir), _fetches(spark, sf_dir))


@query(DELIVERIES + " select topic, group_id, seq, deliveries from dels where not acked and delivered_at + interval 30 second < timestamp '2024-01-31 00:00:00' and deliveries < 5")
def group_redeliver(spark, sf_dir):
    return groups.redeliver(tables.deliveries(spark, sf_dir), at(AS_OF)).select("topic", "group_id", "seq", _long("deliveries"))


@query(DELIVERIES + " select topic, group_id, seq, deliveries from dels where not acked and delivered_at + interval 30 second < timestamp '2024-01-31 00:00:00' and deliveries >= 5")
def group_parked(spark, sf_dir):
    return groups.parked(tables.deliveries(spark, sf_dir), at(AS_OF)).select("topic", "group_id", "seq", _long("deliveries"))


@query(DELIVERIES + " select topic, group_id, seq from dels where not acked and delivered_at + interval 432000 second >= timestamp '2024-01-15 00:00:00' and delivered_at <= timestamp '2024-01-15 00:00:00'")
def group_pending(spark, sf_dir):
    return groups.pending(tables.deliveries(spark, sf_dir).filter(F.col("delivered_at") <= at("2024-01-15 00:00:00")), at("2024-01-15 00:00:00"), 5 * 86_400_000).select("topic", "group_id", "seq")


def _group_ops(spark, sf_dir):
    """Acks in event order; event 4000 + k of each topic is a seek, and later acks carry the next generation, but for a few."""
    base = tables.log(spark, sf_dir).withColumn("group_id", F.lit("g1"))
    op = F.when(F.col("event_id") % 2500 == 400, "seek_beginning").otherwise("ack")
    return base.select("topic", "group_id", F.col("event_id").alias("op_seq"), "ts", op.alias("op"), F.lit("w0").alias("consumer_id"), (1 + F.floor(F.col("event_id") % 10_000 / 5000)).cast("long").alias("generation"), "seq", F.lit(None).cast("int").alias("max_n"))


@query(LOG + """, ops as (select topic, event_id as op_seq, seq, case when event_id % 2500 = 400 then 'seek' else 'ack' end as op, cast(1 + floor(event_id % 10000 / 5000) as bigint) as generation from log),
 seeks as (select topic, max(op_seq) as last_seek, count(*) as n from ops where op = 'seek' group by topic)
 select o.topic, op_seq, seq from ops o left join seeks s on o.topic = s.topic where op = 'ack' and op_seq > coalesce(last_seek, -1) and generation = coalesce(n, 0) + 1""")
def group_seek(spark, sf_dir):
    """Acks that count: after the last seek, of the current generation."""
    return groups.since_seek(_group_ops(spark, sf_dir)).select("topic", "op_seq", "seq")


@query(LOG + """, ops as (select topic, event_id as op_seq, seq, case when event_id % 2500 = 400 then 'seek' else 'ack' end as op, cast(1 + floor(event_id % 10000 / 5000) as bigint) as generation from log),
 seen as (select a.topic, a.op_seq, a.seq, a.generation, count(*) as n from ops a join ops s on a.topic = s.topic and s.op = 'seek' and s.op_seq < a.op_seq where a.op = 'ack' group by all)
 select topic, op_seq, seq, 'FENCED' as reason from seen where generation < n + 1""")
def group_fenced(spark, sf_dir):
    return groups.fenced(_group_ops(spark, sf_dir)).select("topic", "op_seq", "seq", "reason")


@query(DELIVERIES + """, seg as (select topic, cast(floor((seq - 1) / 100) as bigint) as segment, min(seq) as start_seq, sum(25 + strlen(props)) as bytes from log group by 1, 2),
 cum as (select *, sum(bytes) over (partition by topic order by segment desc) as upto, row_number() over (partition by topic order by segment desc) as place from seg),
 heads as (select topic, min(start_seq) as head_seq from cum where place = 1 or upto <= 40000 group by topic)
 select topic, group_id, greatest(ack_floor, head_seq - 1) as ack_floor from floors join heads using (topic)""")
def group_clamp(spark, sf_dir):
    """Floors after retention moved the head."""
    kept = eventlog.retained_segments(EventLog(tables.log(spark, sf_dir)).segments(100), at(AS_OF), 40_000, None)
    return groups.clamp(groups.floors(tables.deliveries(spark, sf_dir)), eventlog.heads(kept)).select("topic", "group_id", "ack_floor")


@query(DELIVERIES + """, r as (select topic, group_id, min(seq) filter (where not acked and deliveries < 5) as first_redeliver, max(seq) + 1 as next_deliver from dels group by all)
 select topic, group_id, greatest(coalesce(first_redeliver, next_deliver), 20, 1) as next_seq from r""")
def group_next_fetch(spark, sf_dir):
    """Where each group fetches next, the head being 20."""
    state = tables.deliveries(spark, sf_dir).groupBy(*groups.KEY).agg(F.min(F.when(~F.col("acked") & (F.col("deliveries") < 5), F.col("seq"))).alias("first_redeliver"), (F.max("seq") + 1).alias("next_deliver"))
    return groups.next_fetch(state.withColumn("head_seq", F.lit(20).cast("long")))


@query()
def group_fold(spark, sf_dir):
    """Exact replay in event order: each row is published, and then one op fetches or acknowledges; retention moves the head."""
    log = tables.log(spark, sf_dir)
    none, event, seq = F.lit(None), F.col("event_id"), F.col("seq")
    join = log.filter("seq = 1").select("topic", F.lit("g1").alias("group_id"), F.lit(-1).cast("long").alias("op_seq"), "ts", F.lit("join").alias("op"), F.lit("w0").alias("consumer_id"), F.lit(1).cast("long").alias("generation"), none.cast("long").alias("seq"), none.cast("int").alias("max_n"))
    step = lambda at, op, to: F.struct((3 * seq + at).alias("op_seq"), op.alias("op"), to.cast("long").alias("seq"))
    own = step(2, F.when(event % 3 == 0, "ack").otherwise("fetch"), F.when(event % 3 == 0, F.greatest(F.lit(1), F.floor(seq / 2))))
    steps = F.array_compact(F.array(step(0, F.lit("publish"), seq), F.when(seq % 500 == 0, step(1, F.lit("head"), seq - 400)), own))
    rest = log.select("topic", F.lit("g1").alias("group_id"), "ts", F.explode(steps).alias("s"), F.lit("w0").alias("consumer_id"), F.lit(1).cast("long").alias("generation"), F.lit(2).alias("max_n"))
    rest = rest.select("topic", "group_id", "s.op_seq", "ts", "s.op", "consumer_id", "generation", "s.seq", "max_n")
    bounds = log.select("topic").distinct().select("topic", F.lit(1).cast("long").alias("head_seq"), F.lit(0).cast("long").alias("last_seq"))
    return groups.fold_groups(join.unionByName(rest), bounds)


@query(DELIVERIES + """, p as (select topic, group_id, count(*) filter (where not acked and deliveries < 5) as pending from dels group by all)
 select topic, group_id, pending, cast(greatest(0, least(25, 100 - pending)) as bigint) as budget from p""")
def group_budget(spark, sf_dir):
    """What a fetch of 25 rows may take when 100 rows may be pending."""
    pending = F.count_if(~F.col("acked") & (F.col("deliveries") < 5)).alias("pending")
    return tables.deliveries(spark, sf_dir).groupBy(*groups.KEY).agg(pending).withColumn("budget", groups.budget(F.lit(25), F.col("pending"), 100).cast("long"))


@query(DELIVERIES + " select topic, group_id, greatest(ack_floor, 49) as ack_floor, greatest(ack_floor, 49) + 1 as next_deliver from floors")
def group_restored(spark, sf_dir):
    """Groups after a restart, the head being 50."""
    log = tables.log(spark, sf_dir)
    heads = log.select("topic").distinct().withColumn("head_seq", F.lit(50).cast("long"))
    return groups.restored(groups.floors(tables.deliveries(spark, sf_dir)), heads).select("topic", "group_id", "ack_floor", "next_deliver")


@query("""select distinct event_type as topic, g.group_id, 'w' || (user_id % 25) as consumer_id, 'leave' as op, 1000 + user_id % 25 as op_seq
 from events, (values ('g1'), ('g2')) g(group_id) where user_id % 25 in (select n_nationkey from nation where n_nationkey % 3 = 1)""")
def group_disconnected(spark, sf_dir):
    """Lost clients leave every group that they had joined."""
    key = (F.col("user_id") % 25).cast("string")
    members = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("c"), key).alias("client_id"), F.col("event_type").alias("topic"), F.concat(F.lit("w"), key).alias("consumer_id")).distinct()
    members = members.select("*", F.explode(F.array(F.lit("g1"), F.lit("g2"))).alias("group_id"))
    nation = tables.table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 1")
    gone = nation.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("client_id"), at(AS_OF).alias("ts"), (1000 + F.col("n_nationkey")).cast("long").alias("op_seq"))
    return groups.disconnected(members, gone).select("topic", "group_id", "consumer_id", "op", "op_seq")


# Key-value


@query(KV + " select key, props as body, expires_at from live")
def kv_live(spark, sf_dir):
    return KvTable(tables.kv_ops(spark, sf_dir)).live(at(AS_OF)).select("key", _text(), "expires_at")


@query(KV + """, ks as (select 'user:' || c_custkey as key from customer)
 select ks.key, l.props as body from ks left join live l using (key)""")
def kv_get_many(spark, sf_dir):
    keys = tables.table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return KvTable(tables.kv_ops(spark, sf_dir)).get(keys, at(AS_OF)).select("key", _text())


@query(KV + " select key, props as body, strftime(expires_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as expires from live where contains(key, '1') order by key limit 20 offset 5")
def kv_scan_page(spark, sf_dir):
    return KvTable(tables.kv_ops(spark, sf_dir)).scan(at(AS_OF), "1", 5, 20).select("key", _text(), rendered_expiry(F.col("expires_at")).alias("expires"))


@query(KV + " select count(*) as total from live where contains(key, '1')")
def kv_count(spark, sf_dir):
    return KvTable(tables.kv_ops(spark, sf_dir)).count(at(AS_OF), "1")


@query(KV + " select key, ts + to_seconds(ttl) as expires_at from ranked where r = 1 and op = 'set' and timestamp '2024-01-31 00:00:00' > ts + to_seconds(ttl)")
def kv_swept(spark, sf_dir):
    return KvTable(tables.kv_ops(spark, sf_dir)).swept(at(AS_OF))


@query(KV.replace("2024-01-31", "2024-01-16") + " select key, props as body from live")
def kv_as_of(spark, sf_dir):
    """The map as it was at an earlier time."""
    return KvTable(tables.kv_ops(spark, sf_dir)).live(at("2024-01-16 00:00:00")).select("key", _text())


# Topics


def _router(spark, sf_dir):
    return TopicRouter(tables.publishes(spark, sf_dir), router.subscriptions(tables.subscription_ops(spark, sf_dir)))


@query(f"with {SUBS}, {PUBS}, {MATCH} select distinct pub_seq, p.topic, client_id from pubs p join matched m on p.topic = m.topic join subs s on s.pattern = m.pattern")
def fanout(spark, sf_dir):
    return _router(spark, sf_dir).deliveries()


@query(f"with {SUBS}, {PUBS}, {MATCH} select pub_seq, p.topic, client_id, s.pattern from pubs p join matched m on p.topic = m.topic join subs s on s.pattern = m.pattern")
def fanout_undeduped(spark, sf_dir):
    return _router(spark, sf_dir).per_pattern()


@query(f"""with subs as (select 'c' || n_nationkey as client_id, 'evt/error/u' || n_nationkey as pattern from nation), {PUBS}, {MATCH},
 d as (select topic, count(distinct client_id) as delivered from matched join subs using (pattern) group by topic)
 select pub_seq, topic, coalesce(delivered, 0) as delivered from pubs left join d using (topic)""")
def fanout_zero(spark, sf_dir):
    """Clients reached by each message; here most reach none."""
    key = F.col("n_nationkey").cast("string")
    subs = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), key).alias("client_id"), F.concat(F.lit("evt/error/u"), key).alias("pattern"))
    return TopicRouter(tables.publishes(spark, sf_dir), subs).counts()


@query(f"with {PUBS}, {HELD} select topic, props as body, expires_at from held where timestamp '{RETAINED_AS_OF}' < expires_at".replace("interval 3600 second", "interval 172800 second").replace("from pubs where retain", f"from pubs where retain and ts <= timestamp '{RETAINED_AS_OF}'"))
def retained_latest(spark, sf_dir):
    published = tables.publishes(spark, sf_dir).filter(F.col("ts") <= at(RETAINED_AS_OF))
    return Retained(published, 2 * 86_400).live(at(RETAINED_AS_OF)).select("topic", _text(), "expires_at")


@query(f"with {SUBS}, {PUBS}, {HELD}, {MATCH} select client_id, s.pattern, h.topic, h.props as body from held h join matched m on h.topic = m.topic join subs s on s.pattern = m.pattern")
def retained_replay(spark, sf_dir):
    """What every subscription gets at once; values live for 40 days here."""
    held = Retained(tables.publishes(spark, sf_dir), 40 * 86_400)
    return held.replay(router.subscriptions(tables.subscription_ops(spark, sf_dir)), at(AS_OF)).select("client_id", "pattern", "topic", _text())


@query(f"with {SUBS} select client_id, pattern from subs")
def unsubscribed(spark, sf_dir):
    """Subscriptions left after unsubscribing and disconnecting."""
    return router.subscriptions(tables.subscription_ops(spark, sf_dir)).select("client_id", "pattern")


@query(f"with {SUBS} select client_id, pattern from subs where client_id not in (select 'c' || n_nationkey from nation where n_regionkey = 2)")
def disconnected(spark, sf_dir):
    gone = tables.table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("client_id"))
    return router.without_clients(router.subscriptions(tables.subscription_ops(spark, sf_dir)), gone).select("client_id", "pattern")


@query(f"""with {SUBS}, {PUBS}, {HELD}, c as (select pattern as path, count(distinct client_id) as subscribers from subs group by pattern)
 select coalesce(c.path, h.topic) as path, coalesce(subscribers, 0) as subscribers, case when timestamp '{AS_OF}' < expires_at then props end as body
 from c full outer join held h on c.path = h.topic where contains(coalesce(c.path, h.topic), 'u') order by 1 limit 20""")
def topic_scan(spark, sf_dir):
    subs = router.subscriptions(tables.subscription_ops(spark, sf_dir))
    return router.topic_page(subs, Retained(tables.publishes(spark, sf_dir)), at(AS_OF), "u", 0, 20).select("path", "subscribers", _text())


@query(f"with {SUBS} select pattern, case when contains(pattern, '#') then 'multi' else 'single' end as kind, count(distinct client_id) as subscribers from subs where contains(pattern, '#') or contains(pattern, '+') group by all")
def wildcard_list(spark, sf_dir):
    return router.wildcard_subscriptions(router.subscriptions(tables.subscription_ops(spark, sf_dir)))


@query("select count(*) as clients from nation where n_nationkey % 9 <> 8")
def active_clients(spark, sf_dir):
    return router.active_clients(tables.subscription_ops(spark, sf_dir))


# Queues


@query(MSGS + """, r as (select *, row_number() over (partition by queue order by priority desc, created_at, id) as rank from msgs where state = 'ready')
 select queue, id, priority, rank from r where rank <= 10""")
def q_dispatch_topk(spark, sf_dir):
    ready = tables.queue_messages(spark, sf_dir).filter("state = 'ready'")
    return workqueue.dispatch(ready, 10).select("queue", "id", _long("priority"), _long("rank"))


@query(MSGS + """, r as (select *, row_number() over (partition by queue order by priority desc, created_at, id) as rank from msgs where state = 'ready')
 select queue, id, attempts + 1 as attempts, timestamp '1997-01-01 00:00:30' as visible_at, 'inflight' as state from r where rank <= 5""")
def q_consumed(spark, sf_dir):
    ready = tables.queue_messages(spark, sf_dir).filter("state = 'ready'")
    return workqueue.consumed(ready, at(QUEUE_AS_OF), 5).select("queue", "id", _long("attempts"), "visible_at", "state")


@query(MSGS + " select queue, id, least(failures, 5) + case when failures < 5 then 1 else 0 end as deliveries, case when failures >= 5 then 'dlq' else 'done' end as outcome from msgs")
def q_outcome(spark, sf_dir):
    return workqueue.outcomes(tables.queue_messages(spark, sf_dir), F.col("failures"), F.lit(5)).select("queue", "id", _long("deliveries"), "outcome")


@query(MSGS + f""" select queue, id, case when attempts >= 5 then 'dlq' else 'ready' end as state, case when attempts >= 5 then 'Timeout' end as reason from msgs
 where state = 'inflight' and visible_at <= timestamp '{QUEUE_AS_OF}'""")
def q_expired(spark, sf_dir):
    flying = tables.queue_messages(spark, sf_dir).filter("state = 'inflight'")
    return workqueue.expired(flying, at(QUEUE_AS_OF), 5).select("queue", "id", "state", "reason")


@query(MSGS + " select queue, id, case when attempts >= 5 then 'dlq' else 'ready' end as state, 'boom' as reason from msgs where id % 11 = 0")
def q_nacked(spark, sf_dir):
    messages = tables.queue_messages(spark, sf_dir)
    nacks = messages.filter("id % 11 = 0").select("queue", "id", F.lit("boom").alias("reason"))
    return workqueue.nacked(messages, nacks, 5).select("queue", "id", "state", "reason")


@query(MSGS + f" select queue, id, case when visible_at > timestamp '{QUEUE_AS_OF}' and attempts > 0 then 'inflight' else 'ready' end as state from msgs")
def q_recovered(spark, sf_dir):
    return workqueue.recovered(tables.queue_messages(spark, sf_dir), at(QUEUE_AS_OF)).select("queue", "id", "state")


@query(MSGS + """ select queue, count(*) filter (where failures < 5 and state = 'ready') as pending, count(*) filter (where failures < 5 and state = 'inflight') as inflight,
 count(*) filter (where failures >= 5) as dlq from msgs group by queue""")
def q_counters(spark, sf_dir):
    messages = tables.queue_messages(spark, sf_dir)
    return workqueue.counters(messages.filter("failures < 5"), messages.filter("failures >= 5"))


@query(MSGS + " select queue, min(visible_at) as deadline from msgs where state = 'inflight' group by queue")
def q_next_deadline(spark, sf_dir):
    return workqueue.next_deadline(tables.queue_messages(spark, sf_dir))


@query(MSGS + " select id, priority, body from msgs where queue = 'O' and state = 'ready' and contains(body, '7') order by priority, created_at, id limit 25 offset 10")
def q_pending_page(spark, sf_dir):
    return workqueue.message_page(tables.queue_messages(spark, sf_dir), "O", "Pending", "7", 10, 25).select("id", _long("priority"), _text())


@query(MSGS + " select id, visible_at, body from msgs where queue = 'F' and state = 'inflight' order by visible_at, created_at, id limit 25")
def q_inflight_page(spark, sf_dir):
    return workqueue.message_page(tables.queue_messages(spark, sf_dir), "F", "inflight", None, 0, 25).select("id", "visible_at", _text())


@query(MSGS + " select queue, id from msgs where id % 5 <> 0")
def q_acked(spark, sf_dir):
    messages = tables.queue_messages(spark, sf_dir)
    return workqueue.acknowledged(messages, messages.filter("id % 5 = 0").select("queue", "id")).select("queue", "id")


def _dead(spark, sf_dir):
    return tables.queue_messages(spark, sf_dir).filter("failures >= 5").withColumn("reason", F.lit("Timeout")).withColumn("dlq_ord", F.col("enqueue_ord"))


@query(MSGS + " select id, failures as attempts, 'Timeout' as reason from msgs where queue = 'P' and failures >= 5 order by created_at desc, id desc limit 10 offset 3")
def dlq_page(spark, sf_dir):
    return workqueue.dlq_page(_dead(spark, sf_dir), "P", None, 3, 10).select("id", F.col("failures").cast("long").alias("attempts"), "reason")


@query(MSGS + " select queue, id, priority, cast(0 as bigint) as attempts, cast(null as varchar) as reason, 'ready' as state from msgs where failures >= 5 and id % 16 = 5")
def dlq_replay(spark, sf_dir):
    dead = _dead(spark, sf_dir)
    return workqueue.replayed(dead, dead.filter("id % 16 = 5")).select("queue", "id", _long("priority"), _long("attempts"), "reason", "state")


@query(MSGS + " select queue, id from msgs where failures >= 5 and id % 16 <> 5")
def dlq_delete(spark, sf_dir):
    dead = _dead(spark, sf_dir)
    return workqueue.without_dead(dead, dead.filter("id % 16 = 5")).select("queue", "id")


@query(MSGS + " select queue, count(*) as purged from msgs where failures >= 5 group by queue")
def dlq_purge_count(spark, sf_dir):
    return workqueue.purge_counts(_dead(spark, sf_dir))


@query(MSGS + " select queue, id, case when failures >= 5 then 'dlq' when visible_at > timestamp '1997-01-01 00:00:00' and attempts > 0 then 'inflight' else 'ready' end as state from msgs")
def q_restarted(spark, sf_dir):
    """Queues after a restart: dead letters stay dead, what is not yet due stays in flight, the rest is ready."""
    dead = _dead(spark, sf_dir).select("queue", "id", F.lit("dlq").alias("state"))
    alive = workqueue.recovered(tables.queue_messages(spark, sf_dir).filter("failures < 5"), at(QUEUE_AS_OF)).select("queue", "id", "state")
    return alive.unionByName(dead)


@query("""with last as (select o_custkey % 100 as k, arg_max(o_orderkey % 3, o_orderkey) as op from orders where o_orderkey % 3 < 2 group by 1)
 select 'q' || k as queue from last where op = 0""")
def q_existing(spark, sf_dir):
    """Queues whose last create or delete is a create."""
    key = F.col("o_orderkey")
    op = F.when(key % 3 == 0, "create").when(key % 3 == 1, "delete").otherwise("push")
    ops = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), (F.col("o_custkey") % 100).cast("string")).alias("queue"), key.alias("op_seq"), op.alias("op"))
    return workqueue.existing(ops)


@query("select o_orderkey as id, 'Queue not found' as reason from orders where o_orderstatus <> 'O'")
def q_unknown(spark, sf_dir):
    """Pushes to queues that were not created."""
    pushes = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("queue"))
    return workqueue.unknown_queue(pushes, spark.createDataFrame([("O",)], "queue string")).select("id", "reason")


@query("with c as (select o_orderstatus as queue, min_by(o_orderkey % 7, o_orderkey) as max_retries from orders group by 1) select queue, max_retries from c")
def q_config(spark, sf_dir):
    """First configuration wins."""
    ops = tables.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("queue"), F.col("o_orderkey").alias("op_seq"), (F.col("o_orderkey") % 7).alias("max_retries"))
    return workqueue.configured(ops).select("queue", "max_retries")


def _queue_ops(spark, sf_dir):
    """Each order is pushed, then one is consumed; every third op pair also acknowledges or rejects the message itself."""
    messages = tables.queue_messages(spark, sf_dir)
    none = F.lit(None)
    rows = messages.select("queue", "id", "priority", "created_at", F.posexplode(F.array(F.lit("push"), F.lit("consume"), F.when(F.col("id") % 3 == 0, "ack").when(F.col("id") % 3 == 1, "nack"))).alias("step", "op")).filter("op is not null")
    consume = F.col("op") == "consume"
    return rows.select(
        "queue", (F.unix_seconds(F.col("created_at").cast("timestamp")) * 10_000_000 + F.col("id") * 4 + F.col("step")).alias("op_seq"), F.col("created_at").alias("ts"), "op",
        F.when(~consume, F.col("id").cast("string")).alias("id"), F.when(F.col("op") == "push", F.col("priority")).cast("int").alias("priority"), F.when(consume, F.lit(1)).alias("max_n"), F.when(F.col("op") == "nack", "boom").otherwise(none).alias("reason"),
    )


@query()
def q_fold(spark, sf_dir):
    """Exact replay of each queue: a retried message goes to the tail, so the order follows from the whole history."""
    return workqueue.fold_queues(_queue_ops(spark, sf_dir))


@query()
def q_states(spark, sf_dir):
    """Every message after the whole log."""
    return workqueue.queue_states(_queue_ops(spark, sf_dir))


# Payloads and listings


@query("select event_id, 'json' as kind, cast(json_extract(props, '$.k') as bigint) as k, strlen(props) + 1 as bytes from events")
def payload_json(spark, sf_dir):
    log = tables.log(spark, sf_dir)
    return log.select("event_id", pl.kind(F.col("payload")).alias("kind"), pl.field(F.col("payload"), "$.k", "bigint").alias("k"), _size("payload", "bytes"))


def _size(column: str, name: str) -> Column:
    return pl.byte_size(F.col(column)).cast("long").alias(name)


@query("""select event_id, case event_id % 3 when 0 then '0x' || lower(hex(event_type)) when 1 then event_type else props end as body,
 case event_id % 3 when 0 then 'raw' when 1 then 'string' else 'json' end as kind from events""")
def payload_kinds(spark, sf_dir):
    """The three kinds of payload, encoded and shown."""
    third = F.col("event_id") % 3
    coded = F.when(third == 0, pl.encode_raw(F.col("event_type"))).when(third == 1, pl.encode_string(F.col("event_type"))).otherwise(pl.encode_json(F.col("props")))
    return tables.table(spark, sf_dir, "events").select("event_id", coded.alias("payload")).select("event_id", _text(), pl.kind(F.col("payload")).alias("kind"))


@query(LOG + " select topic, seq, seq as read_seq, strlen(props) + 1 <= 24 as small from log")
def payload_limits(spark, sf_dir):
    """A record's number read back from its bytes, and whether the payload is within 24 bytes."""
    record = eventlog.record(F.col("seq"), F.col("ts"), F.col("payload"))
    return tables.log(spark, sf_dir).select("topic", "seq", pl.read_uint(record, 8, 8).cast("long").alias("read_seq"), pl.within_limit(F.col("payload"), 24).alias("small"))


@query("select c_custkey, c_name from customer where contains(lower(c_name), '00001') order by c_name, c_custkey limit 30 offset 5")
def name_page(spark, sf_dir):
    """A filtered, ordered page of names."""
    from sluice.functions.common import name_matches

    customer = tables.table(spark, sf_dir, "customer").filter(name_matches("c_name", "00001"))
    return page(customer, [F.col("c_name"), F.col("c_custkey")], 5, 30).select("c_custkey", "c_name")
