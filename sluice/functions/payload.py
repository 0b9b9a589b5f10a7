"""Typed payloads: one tag byte (0 raw, 1 string, 2 JSON), then content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW, STRING, JSON = 0, 1, 2


def _tag(payload: Column) -> Column:
    return F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")


def tagged(payload: Column) -> Column:
    """The first byte is a tag; otherwise the whole payload is JSON."""
    return (F.length(payload) > 0) & (_tag(payload) <= JSON)


def kind(payload: Column) -> Column:
    """raw, string, json, or null for an empty payload."""
    names = F.when(_tag(payload) == RAW, "raw").when(_tag(payload) == STRING, "string").otherwise("json")
    return F.when(payload.isNull() | (F.length(payload) == 0), F.lit(None).cast("string")).when(tagged(payload), names).otherwise("json")


def content(payload: Column) -> Column:
    return F.when(tagged(payload), F.substring(payload, F.lit(2), F.length(payload))).otherwise(payload)


def lossy(content_: Column) -> Column:
    """Text with malformed UTF-8 replaced."""
    return F.make_valid_utf8(content_.cast("string"))


def text(payload: Column) -> Column:
    """How the inspection views show a payload: 0x and lower-case hex for raw bytes, else text; null if empty."""
    raw = F.concat(F.lit("0x"), F.lower(F.hex(content(payload))))
    return F.when(kind(payload) == "raw", raw).when(kind(payload).isNotNull(), lossy(content(payload)))


def json_value(payload: Column) -> Column:
    """The payload as a variant: JSON where it parses, otherwise its text as a JSON string; null if empty."""
    quoted = F.try_variant_get(F.parse_json(F.to_json(F.struct(text(payload).alias("v")))), "$.v", "variant")
    return F.when(kind(payload) == "json", F.coalesce(F.try_parse_json(lossy(content(payload))), quoted)).when(kind(payload).isNotNull(), quoted)


def field(payload: Column, path: str, type_: str) -> Column:
    """A field of a JSON payload; null for other kinds and bad JSON."""
    return F.when(kind(payload) == "json", F.try_variant_get(F.try_parse_json(lossy(content(payload))), path, type_))


def encode_raw(value: Column) -> Column:
    return F.concat(F.unhex(F.lit("00")), value.cast("binary"))


def encode_string(value: Column) -> Column:
    return F.concat(F.unhex(F.lit("01")), F.to_binary(value, F.lit("utf-8")))


def encode_json(value: Column) -> Column:
    """value is JSON text; null encodes as the JSON null."""
    return F.concat(F.unhex(F.lit("02")), F.to_binary(F.coalesce(value, F.lit("null")), F.lit("utf-8")))


def byte_size(payload: Column) -> Column:
    return F.octet_length(payload)


def within_limit(payload: Column, most: int) -> Column:
    return F.coalesce(F.octet_length(payload), F.lit(0)) <= most


def read_uint(data: Column, offset: int, size: int) -> Column:
    """A big-endian unsigned number at a byte offset."""
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("decimal(20,0)")
