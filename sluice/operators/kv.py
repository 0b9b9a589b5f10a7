"""Key-value map with expiry: the last write of each key in an op log.

ops(op_seq, ts, op set|del, key, payload, ttl_s).  A ttl of null or 0 means the default; a value is live while
as_of <= expires_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.common import KV_PAGE_DEFAULT, KV_TTL_S, NEVER, latest_by, page, plus_seconds


def expires_at(ts: Column, ttl_s: Column, default_ttl_s: int = KV_TTL_S) -> Column:
    return plus_seconds(ts, F.coalesce(F.nullif(ttl_s, F.lit(0)), F.lit(default_ttl_s)))


class KvTable:
    def __init__(self, ops: DataFrame, default_ttl_s: int = KV_TTL_S):
        self.ops, self.default_ttl_s = ops, default_ttl_s

    def last(self, as_of: Column) -> DataFrame:
        """key, op, payload, expires_at, op_seq: the last write of each key up to as_of, expired and deleted ones too."""
        seen = self.ops.filter(F.col("ts") <= as_of).select("key", "op_seq", "op", "payload", expires_at(F.col("ts"), F.col("ttl_s"), self.default_ttl_s).alias("expires_at"))
        return latest_by(seen, ["key"], "op_seq")

    def live(self, as_of: Column) -> DataFrame:
        """key, payload, expires_at."""
        return self.last(as_of).filter((F.col("op") == "set") & (as_of <= F.col("expires_at"))).select("key", "payload", "expires_at")

    def get(self, keys: DataFrame, as_of: Column) -> DataFrame:
        """keys(key) -> key, payload, expires_at; null where a key is missing or expired."""
        return keys.join(self.live(as_of), "key", "left")

    def scan(self, as_of: Column, search: str | None = None, offset: int = 0, limit: int | None = KV_PAGE_DEFAULT) -> DataFrame:
        """A page of live entries by key, after expiry and filter."""
        return page(self.filtered(as_of, search), [F.col("key")], offset, limit)

    def filtered(self, as_of: Column, search: str | None = None) -> DataFrame:
        live = self.live(as_of)
        return live.filter(F.contains("key", F.lit(search))) if search else live

    def count(self, as_of: Column, search: str | None = None) -> DataFrame:
        return self.filtered(as_of, search).agg(F.count(F.lit(1)).alias("total"))

    def swept(self, as_of: Column) -> DataFrame:
        """Keys whose last value has expired: what a sweep would drop."""
        return self.last(as_of).filter((F.col("op") == "set") & (as_of > F.col("expires_at"))).select("key", "expires_at")

    def compacted(self, as_of: Column) -> DataFrame:
        """The op log reduced to one row for each live key; a table over it gives the same answers from as_of on."""
        last = latest_by(self.ops.filter(F.col("ts") <= as_of), ["key"], "op_seq")
        return last.filter((F.col("op") == "set") & (as_of <= expires_at(F.col("ts"), F.col("ttl_s"), self.default_ttl_s)))


def rendered_expiry(expires: Column) -> Column:
    """RFC 3339, or Never."""
    return F.coalesce(F.date_format(expires.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(NEVER))
