"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask selects some of `SPAN` consecutive word places and ignores the rest, so a seed still matches where words at
ignored places were substituted.  The seeds of every place of every text are joined with the benchmark's: what is
shuffled or joined there is (text, place, seed), never the words.  A hit fixes a diagonal (text place - item place), and
each diagonal of a text and an item goes on once.  Only texts with hits are read again; along each diagonal the item is
laid over the text, and the overlap stands if `EQUAL` of some `WINDOW` consecutive places of the item agree (of a
shorter item, that share of all its places).  It is then grown to all of the item that the text holds.

Items of fewer than `SHORT` words have few places for a seed, so they are looked for by `SHORT_MASKS` too, of which one
ignores any given place: none with a single substitution is missed.

Texts are told apart by doc_id and two hashes of the text, 128 bits.  The benchmark's seeds are broadcast only after
their number has been counted and found below `BROADCAST_SEEDS`, and so are the diagonals (`BROADCAST_HITS`); beyond
that the joins are the planner's.  Hits are first joined on the seed alone, whatever number of texts share it, and are
spread by text after that.

Defined results: null texts and texts shorter than a seed overlap nothing, and so do such items; equal items are each
reported; of an item's diagonals in a text that agree alike the smallest is reported; repeated documents are reported
once for each doc_id, the one that agrees best; very long texts take time in proportion; other columns, whatever their
names, are ignored; an empty table on either side gives no rows.  `without_overlaps` does not rest on doc_id: each row
is judged by its own text, so a null doc_id is judged like any other, and of rows that share a doc_id only those that
overlap an item go; it returns all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.runtime import Scratch, columns
from sluice.llm.words import alnum_words, spots, word

MASKS = ("111010011", "110010111", "101101101")
SHORT_MASKS = ("000111111", "111000111", "111111000")
SPAN, SHORT = 9, 13
WINDOW, EQUAL = 13, 11
BROADCAST_SEEDS, BROADCAST_HITS = 1_000_000, 200_000
#: The columns that tell texts apart.
TEXT = ["text_a", "text_b"]


def _keyed(docs: DataFrame, *others: Column) -> DataFrame:
    """docs(text) -> TEXT, text and the others."""
    return docs.select(F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"), F.col("text").cast("string").alias("text"), *others)


def _seeded(rows: DataFrame, keys: list[str], place: str, masks: tuple[str, ...]) -> DataFrame:
    """rows(keys, words) -> keys, place, seed: at every place one for each mask, from word hashes; the mask is hashed too."""
    at = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).select(*keys, "hashes", spots("hashes", 0, SPAN - 1).alias(place))
    seed = lambda mask: F.xxhash64(F.lit(int(mask, 2)), *[word("hashes", F.col(place) + j) for j, bit in enumerate(mask) if bit == "1"])
    return at.select(*keys, place, F.explode(F.array(*map(seed, masks))).alias("seed"))


def _standing(texts: DataFrame, benchmark: DataFrame, carried: list[str]) -> DataFrame:
    """texts(TEXT, text, carried) -> TEXT, carried, item_id, diagonal, lo, hi, n_equal: every overlap that stands."""
    scratch = Scratch(texts.sparkSession)
    items = columns(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), alnum_words(F.col("text")).alias("words")).filter(F.size("words") >= SPAN)
    brief = items.filter(F.size("words") < SHORT)
    masks = MASKS if brief.isEmpty() else MASKS + SHORT_MASKS
    seeds = scratch.keep(_seeded(items, ["item_id"], "p", MASKS).unionByName(_seeded(brief, ["item_id"], "p", SHORT_MASKS)))
    small = seeds.count() <= BROADCAST_SEEDS

    hits = _seeded(texts.select(*TEXT, alnum_words(F.col("text")).alias("words")), TEXT, "i", masks).join(F.broadcast(seeds) if small else seeds, "seed")
    diagonals = scratch.keep(hits.select(*TEXT, "item_id", (F.col("i") - F.col("p")).alias("diagonal")).distinct())
    few = diagonals.count() <= BROADCAST_HITS
    laid = texts.join(F.broadcast(diagonals) if few else diagonals, TEXT).join(items.withColumnRenamed("words", "item"), "item_id")
    laid = laid.select(*TEXT, *carried, "item_id", "diagonal", "item", alnum_words(F.col("text")).alias("words"))
    ahead = F.greatest(-F.col("diagonal"), F.lit(0))  # places of the item before the text's first word
    under = F.concat(F.array_repeat(F.lit(None).cast("string"), ahead), F.slice("words", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.greatest(F.size("item") - ahead, F.lit(0))))
    agree = F.zip_with("item", under, lambda w, own: F.coalesce(own == w, F.lit(False)).cast("int"))
    # explode() of one array keeps it from being worked out again for each window.
    laid = laid.select(*TEXT, *carried, "item_id", "diagonal", F.explode(F.array(agree)).alias("agree"))
    width = F.least(F.lit(WINDOW), F.size("agree"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("agree") - width), lambda s: F.aggregate(F.slice("agree", s + 1, width), F.lit(0), lambda a, b: a + b)))
    first, last = F.array_position("agree", 1) - 1, F.size("agree") - F.array_position(F.reverse("agree"), 1)
    return laid.filter(best >= F.ceil(width * EQUAL / WINDOW)).select(
        *TEXT, *carried, "item_id", "diagonal", first.alias("lo"), last.alias("hi"), F.aggregate("agree", F.lit(0), lambda a, b: a + b).cast("long").alias("n_equal")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, doc_start, item_start, length, n_equal: in words, one row for each item a document overlaps."""
    texts = _keyed(columns(docs, "doc_id", "text"), F.col("doc_id").cast("long").alias("doc_id"))
    return (
        _standing(texts, benchmark, ["doc_id"])
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_equal", (-F.col("diagonal")).alias("order"), "diagonal", "lo", "hi")).alias("b"))
        .select("doc_id", "item_id", (F.col("b.diagonal") + F.col("b.lo")).cast("long").alias("doc_start"), F.col("b.lo").cast("long").alias("item_start"), (F.col("b.hi") - F.col("b.lo") + 1).cast("long").alias("length"), F.col("b.n_equal").alias("n_equal"))
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that overlap no benchmark item, each judged by its own text."""
    scratch = Scratch(docs.sparkSession)
    plain = columns(docs, "text")
    found = scratch.keep(_standing(_keyed(plain), benchmark, []).select(TEXT).distinct())
    found = F.broadcast(found) if found.count() <= BROADCAST_HITS else found
    keys = [F.xxhash64("text").alias(TEXT[0]), F.xxhash64(F.lit(1), "text").alias(TEXT[1])]
    return plain.select("*", *keys).join(found, TEXT, "left_anti").select(plain.columns).toDF(*docs.columns)
