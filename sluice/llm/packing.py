"""Packing of whole documents into token sequences by vector best fit.

An item is a vector (tokens, one document, attention cost = tokens squared), and so is what a sequence has left.  Items
go longest first, each into the sequence that fits best under every capacity: rule "norm" takes the smallest weighted
norm of what would be left, rule "dot" the largest weighted dot product of item and residual.

Items of one length are alike, and sequences with equal residuals are too, so the plan is made on a histogram: at most
`capacity` counts, whatever the number of documents.  It says for each length which ranks go to which run of sequences
at which offset.  Ranks are per-partition counters plus a running total, so no task sees all pieces of one length.

Defined results: null or empty text is the end token alone; a document longer than a sequence is cut into full pieces
after a first piece that takes the remainder; repeated rows are packed as often as they come; nothing is dropped; of
sequences that fit alike the one opened first is taken; very long texts are encoded one at a time; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import textkit as tk
from sluice.llm.runtime import Scratch, columns

END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, dealt long, local long"
#: Weight of each dimension, as a share of its capacity, in the choice of a sequence.
WEIGHTS = (1.0, 1.0, 1.0)
#: The least documents that a sequence is to hold where the number is chosen by the plan.
LEAST_DOCUMENTS = 8


@lru_cache(maxsize=2)
def encoder(name: str):
    """text -> ids as the tokenizers library gives them for `name`.json; the same vocabulary's fast encoder where no added token occurs."""
    import base64

    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(files.path(f"{name}.json"))
    with open(files.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [str(x.content) for x in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if not any(x in text for x in added):
            try:
                return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except BaseException as stuck:  # the pattern engine gives up on megabytes of white space
                if isinstance(stuck, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def _cut(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dealt, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, texts in tk.slices(batches):
            rows: list[tuple] = []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                ids = np.append(encode(texts.raw(i).decode()), np.uint32(END)).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    size = len(ids) % capacity if piece == 0 and len(ids) % capacity else capacity
                    rows.append((doc, piece, at, size, zlib.crc32(ids[at : at + size].tobytes()), dealt, int(seen[size])))
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "dealt", "local"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "piece" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    return run


def plan(counts: dict[int, int], capacity: int, documents: int, cost: int, rule: str = "norm", weights: tuple = WEIGHTS) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset): vector best fit, longest first, over counts by length."""
    whole = np.array([capacity, documents, cost], float)
    weight = np.array(weights) / whole
    left = np.empty((0, 3), np.int64)  # of each class of sequences: what is left, and below its first sequence and size
    first, size = np.empty(0, np.int64), np.empty(0, np.int64)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        item = np.array([length, 1, length * length], np.int64)
        if (item > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while n:
            fits = np.flatnonzero((left >= item).all(axis=1))
            if len(fits):
                if rule == "norm":
                    score = (((left[fits] - item) * weight) ** 2).sum(axis=1)
                else:
                    score = -(left[fits] * weight * item * weight).sum(axis=1)
                k = int(fits[score.argmin()])
                residual, begin, many = left[k], int(first[k]), int(size[k])
            else:
                k, residual, begin, many = -1, whole.astype(np.int64), opened, n
            # Under "norm" a sequence just filled fits best again until it is full; under "dot" it comes last.  Where no
            # other fits, the sequence just opened is filled before the next is opened.
            stack = int((residual // item).min()) if rule == "norm" or k < 0 else 1
            bins, copies = (min(many, n // stack), stack) if n >= stack else (1, n)
            for c in range(copies):
                out.append((length, rank, bins, begin, capacity - int(residual[0]) + c * length))
                rank += bins
            n -= bins * copies
            rest = residual - copies * item
            if k < 0:
                opened += bins
            elif bins == many:
                left, first, size = np.delete(left, k, 0), np.delete(first, k), np.delete(size, k)
            else:
                first[k] += bins
                size[k] -= bins
            if rest[0] > 0:
                left, first, size = np.vstack([left, rest]), np.append(first, begin), np.append(size, bins)
    return np.array(out, np.int64).reshape(-1, 5)


def opened(rows: np.ndarray) -> int:
    """Sequences of a plan."""
    return int((rows[:, 3] + rows[:, 2]).max()) if len(rows) else 0


def tightest(counts: dict[int, int], capacity: int, cost: int, rule: str) -> np.ndarray:
    """The plan under the smallest document capacity, of LEAST_DOCUMENTS and its doubles, that costs no sequence.

    With as many documents as tokens that capacity cannot bind, so the plan never opens more sequences than one that
    minds tokens and cost alone, and of those plans it is one that spreads short documents most evenly.
    """
    free = plan(counts, capacity, capacity, cost, rule)
    documents = LEAST_DOCUMENTS
    while documents < capacity:
        if documents * opened(free) >= sum(counts.values()):
            bound = plan(counts, capacity, documents, cost, rule)
            if opened(bound) <= opened(free):
                return bound
        documents *= 2
    return free


def _placed(rows: np.ndarray):
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))] if len(rows) else rows
    key = rows[:, 0] << 48 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(key, batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(rows[k, 3] + rank - rows[k, 1]), pa.array(rows[k, 4])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 1024, documents: int | None = None, cost: int | None = None, rule: str = "norm", tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Without `documents` the plan chooses that capacity (`tightest`); without `cost` it is the square of `capacity`, the
    cost of one full piece, which no smaller one could hold.
    """
    cost = capacity * capacity if cost is None else cost
    scratch = Scratch(docs.sparkSession)
    plain = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(plain.mapInArrow(_cut(tokenizer, capacity), PIECES))
    each = scratch.keep(pieces.groupBy("length", "dealt").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "dealt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "dealt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(_placed(tightest(counts, capacity, cost, rule) if documents is None else plan(counts, capacity, documents, cost, rule)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
