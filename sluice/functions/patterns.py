"""Topic patterns: levels divided by /, + for one level, # for the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levels(pattern: Column) -> Column:
    """The pattern's levels before the first level that is #."""
    tokens = F.split(pattern, "/")
    cut = F.array_position(tokens, "#")
    return F.when(cut > 0, F.slice(tokens, 1, (cut - 1).cast("int"))).otherwise(tokens)


def is_multi(pattern: Column) -> Column:
    return F.array_contains(F.split(pattern, "/"), "#")


def is_exact(pattern: Column) -> Column:
    tokens = F.split(pattern, "/")
    return ~F.array_contains(tokens, "#") & ~F.array_contains(tokens, "+")


def regex(pattern: Column) -> Column:
    """An anchored regular expression for a pattern; wildcards count only as whole levels."""
    own = levels(pattern)
    quoted = F.transform(own, lambda t: F.when(t == "+", F.lit("[^/]*")).otherwise(F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))))
    body = F.array_join(quoted, "/")
    rest = F.when(~is_multi(pattern), F.lit("")).when(F.size(own) == 0, F.lit(".*")).otherwise(F.lit("(/.*)?"))
    return F.concat(F.lit("(?s)^"), body, rest, F.lit("$"))


def matches(topic: Column, pattern: Column) -> Column:
    return F.rlike(topic, regex(pattern))


def anchor(pattern: Column) -> Column:
    """The first literal level as struct(level from 1, token), by which patterns and topics are joined; (0, '') without one."""
    own = levels(pattern)
    at = F.array_position(F.transform(own, lambda t: t != "+"), True).cast("int")
    return F.struct(at.alias("level"), F.when(at > 0, F.element_at(own, F.greatest(at, F.lit(1)))).otherwise("").alias("token"))


def anchors(topic: Column) -> Column:
    """Every anchor that a pattern matching this topic can have."""
    tokens = F.split(topic, "/")
    own = F.transform(tokens, lambda t, i: F.struct((i + 1).cast("int").alias("level"), t.alias("token")))
    return F.concat(F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("token"))), own)


def listing_kind(pattern: Column) -> Column:
    """How listings classify a pattern: by containing a wildcard character anywhere."""
    return F.when(F.contains(pattern, F.lit("#")), "multi").when(F.contains(pattern, F.lit("+")), "single")
