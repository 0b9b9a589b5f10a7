"""Pieces that several operators share."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Defaults of the settings that bear on results.
KV_TTL_S = RETAINED_TTL_S = 3600
VISIBILITY_MS = ACK_WAIT_MS = 30_000
MAX_RETRIES = MAX_DELIVERIES = 5
MAX_ACK_PENDING = 10_000
CONSUME_BATCH = 10
PAGE_DEFAULT, PAGE_CAP = 50, 500
QUEUE_PAGE_CAP, KV_PAGE_DEFAULT = 1000, 500
RETENTION_BYTES, RETENTION_MS = 1 << 30, 7 * 24 * 3600 * 1000
SEGMENT_BYTES = 100 << 20
MAX_PAYLOAD = 10 << 20
NEVER = "Never"

_NAME = re.compile(r"[^/\\\x00]+")


def at(when: datetime | str) -> Column:
    """An explicit point in time; no query reads the clock."""
    text = when.isoformat(sep=" ") if isinstance(when, datetime) else when
    return F.lit(text).cast("timestamp_ntz")


def plus_seconds(time: Column, seconds: Column) -> Column:
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def plus_ms(time: Column, ms: Column) -> Column:
    return plus_seconds(time, ms.cast("decimal(18,3)") / 1000)


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest `order` for each key: an aggregate with map-side combine, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First write wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int | None = PAGE_DEFAULT, cap: int | None = None) -> DataFrame:
    """One page of an ordered listing: a top-k of offset + limit, not a full sort."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit are at least 0")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(min(limit, cap) if cap else limit)


def name_matches(column: str, search: str | None) -> Column:
    """Case-insensitive name filter; no search matches all."""
    return F.contains(F.lower(F.col(column)), F.lit(search.lower())) if search else F.lit(True)


def checked_name(name: str) -> str:
    """A resource name that can't leave its folder."""
    if not _NAME.fullmatch(name) or name in (".", ".."):
        raise ValueError(f"not a resource name: {name!r}")
    return name
