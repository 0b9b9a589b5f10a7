"""Words of whole texts as columns: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A to Z lower-cased; null text has none.

    lower() is the faster, and lower-cases letters beyond ASCII too, so it serves texts of ASCII only.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word(words: str, at: Column) -> Column:
    return F.get(F.col(words), at)


def spots(words: str, first: int = 0, short: int = 0) -> Column:
    """explode() of the places first, first + 1, ... of words, up to `short` before the end; nothing if there is none."""
    last = F.size(words) - 1 - short
    return F.explode(F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>")))
