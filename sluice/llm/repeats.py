"""Removal of repeated passages: every byte covered by a `length`-byte string that a smaller doc_id also holds.

Prefix doubling over sampled suffixes.  Naming every byte position by rank pairs, level after level, would shuffle
tens of bytes for each byte of text; instead

1.  documents are dealt into blocks of bounded size, and in each block every window of `length` bytes elects one
    position, the leftmost with the smallest hash of the next 16 bytes (rank 1), among the `length - 15` that fit.  Its
    rank 2 is the pair of its rank 1 and that 16 bytes later, or where these are not in the window, 16 bytes earlier.
    Equal windows elect equal positions, so equal windows meet if elected positions with equal rank 2 meet;
2.  Spark deals the elected positions by rank 2, four bytes a position, and those whose rank is unique drop out;
3.  the rest are dealt again with the bytes of their windows.  In a block equal contexts go once, with the smallest
    doc_id, so that a passage held by a third of all documents costs one row part for each block.  A rank that more
    than `HOT` blocks have may stand in as many different surroundings, so its windows are dealt one by one, by a hash
    of all their bytes.  The windows are named by doubling, 16 to 32 to `length` bytes, each name a pair of names half
    as long (two independent 64-bit names, so 128 bits decide), and windows with equal names are reranked by doc_id;
4.  what a smaller doc_id holds goes back to the blocks as runs of windows, and there becomes removed bytes.

A block sends one row to each bucket that it has positions for, never more rows than positions.

Defined results: null text is empty; matches never cross documents and are judged on the input, also where they
overlap; rows with equal doc_id, repeated rows among them, never remove one another; a text longer than a block is a
block's only one; other columns, whatever their names, are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import textkit as tk
from sluice.llm.profile import summed
from sluice.llm.runtime import columns, parts, small_batches, text_bytes

KEY = 16
#: Bytes of text in a block, and for each bucket of elected positions; one task holds the former, and what is elected in the latter.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
#: Blocks that may have a rank before its windows are dealt one by one.
HOT = 256
U = np.uint64
_CODEC = "zstd"


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=3).compress(raw, asbytes=True)


def _expand(blob: bytes) -> bytes:
    return pa.Codec(_CODEC).decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)


def paired(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Names for pairs of names: random odd multiples, added."""
    odd = tk.stream(2, seed) | U(1)
    out = a * odd[0]
    out += b * odd[1]
    return out


def elect(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that elect the same position and extend its rank alike: first window, last window, position, rank 2, text index."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U, np.int64))
    words = tk.eights(data)[: n - 7]
    hashes = paired(words[:-8], words[8:], 7)
    hashes ^= hashes >> U(32)
    hashes *= U(0xBF58476D1CE4E5B9)
    low = (hashes >> U(40)) << U(40)
    low |= np.arange(len(hashes), dtype=U)
    low = low.view(np.int64) ^ np.int64(-(1 << 63))  # signed order is that of the unsigned numbers
    wide, size = length - KEY + 1, 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    at = low & np.int64((1 << 40) - 1)
    valid = np.ones(len(at), bool)  # windows that stay in one text
    ends = off[1:-1]
    for k in range(1, length):
        crossing = ends - k
        valid[crossing[(crossing >= 0) & (crossing < len(at))]] = False
    later = at - np.arange(len(at)) <= length - 2 * KEY  # the rank's second half follows its first
    change = (at[1:] != at[:-1]) | (later[1:] != later[:-1])
    fresh = np.ones(len(at), bool)
    fresh[1:] = change | ~valid[:-1]
    fresh &= valid
    close = np.ones(len(at), bool)
    close[:-1] = change | ~valid[1:]
    close &= valid
    first, last = np.flatnonzero(fresh), np.flatnonzero(close)
    spot = at[first]
    begin = spot - np.where(later[first], 0, KEY)
    return first, last, spot, tk.mix(paired(tk.mix(hashes[begin]), tk.mix(hashes[begin + KEY]), 9) + later[first]), np.searchsorted(off, first, side="right") - 1


class Block:
    """The documents of one block and their distinct contexts, in an order that depends on the documents alone."""

    def __init__(self, docs: pa.Table, length: int, buckets: int):
        docs = docs.sort_by([("rank_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.docs, self.ids = docs, docs["rank_id"].to_numpy()
        texts = tk.Texts(docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string()))
        self.data, self.off, self.length, self.buckets = texts.data, texts.off, length, buckets
        found = []
        for begin, end in tk.runs(self.off):
            base = self.off[begin]
            own = self.data[base : self.off[end]]
            first, last, at, key, text = elect(own, self.off[begin : end + 1] - base, length)
            up, down = tk.powers(len(own) + 1)
            sums = np.zeros(len(own) + 1, U)
            np.cumsum(tk.BYTE_CODES[own] * up[: len(own)], out=sums[1:])
            whole = (sums[last + length] - sums[first]) * down[first]
            found.append((first + base, last + base, at + base, key, text + begin, whole))
        blank = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, U, np.int64, U)]
        self.first, self.last, at, key, self.text, whole = (np.concatenate(x) for x in zip(*found, strict=True)) if found else blank
        del found
        shape = key + (self.last - self.first).astype(U) * U(1 << 20) + (at - self.first).astype(U)
        whole = tk.mix(whole ^ tk.mix(shape))
        bits = max(buckets.bit_length(), 1)
        bucket = key % U(buckets)
        order = np.argsort((bucket << U(64 - bits)) | (whole >> U(bits)))
        new = np.ones(len(order), bool)
        w, s = whole[order], shape[order]
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
        start = np.flatnonzero(new)
        self.context = np.empty(len(order), np.int64)
        self.context[order] = np.cumsum(new) - 1
        docs_of = self.ids[self.text]
        self.smallest = np.minimum.reduceat(docs_of[order], start) if len(start) else np.empty(0, np.int64)
        one = order[start]
        self.bucket = bucket[one].astype(np.int64)
        self.begin, self.windows, self.elected = self.first[one], (self.last - self.first)[one] + 1, (at - self.first)[one]
        # Distinct ranks, by bucket, and the rank of each context.
        self.ranks, self.rank = np.unique((bucket[one] << U(32)) | (key[one] >> U(32)), return_inverse=True)


def _edges(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal numbers."""
    edges = np.append(np.flatnonzero(np.diff(sorted_, prepend=-1)), len(sorted_)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


RANKS = "bucket long, block long, blob binary"


def _ranks(length: int, buckets: int):
    def run(key, docs):
        block = Block(docs, length, buckets)
        of = (block.ranks >> U(32)).astype(np.int64)
        rows = [(int(of[lo]), key[0].as_py(), block.ranks[lo:hi].astype("<u4").tobytes()) for lo, hi in _edges(of)]
        return pa.table(list(zip(*rows, strict=True)) or [[], [], []], schema=pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())]))

    return run


def _met(hot: int):
    """For each block two bits for each of its ranks: another block has it too, and more than `hot` blocks have it."""

    def run(key, rows):
        ranks = [np.frombuffer(x.as_py(), "<u4") for x in rows["blob"]]
        sizes = [len(x) for x in ranks]
        together = np.concatenate(ranks)
        order = np.argsort(together, kind="stable")
        start = np.flatnonzero(np.append(True, together[order][1:] != together[order][:-1]))
        times = np.empty(len(together), np.int64)
        times[order] = np.repeat(np.diff(np.append(start, len(order))), np.diff(np.append(start, len(order))))
        masks = [np.packbits(np.concatenate([x > 1, x > hot])).tobytes() for x in np.split(times, np.cumsum(sizes)[:-1])]
        return pa.table({"bucket": rows["bucket"], "block": rows["block"], "blob": pa.array(masks, pa.binary())})

    return run


def _contexts(length: int, buckets: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("contexts", pa.int64()), ("blob", pa.binary())])

    def run(key, docs, masks):
        block = Block(docs, length, buckets)
        shared = np.bincount(block.rank, minlength=len(block.ranks)) > 1
        hot = np.zeros(len(block.ranks), bool)
        mask_of = dict(zip(masks["bucket"].to_pylist(), masks["blob"], strict=True))
        for lo, hi in _edges((block.ranks >> U(32)).astype(np.int64)):
            mask = np.unpackbits(np.frombuffer(mask_of[int(block.ranks[lo] >> U(32))].as_py(), np.uint8), count=2 * (hi - lo)).astype(bool)
            shared[lo:hi] |= mask[: hi - lo]
            hot[lo:hi] = mask[hi - lo :]
        some = len(block.ranks) > 0
        kept = np.flatnonzero(shared[block.rank] & ~hot[block.rank]) if some else np.empty(0, np.int64)
        bucket, shift, windows = block.bucket[kept], np.zeros(len(kept), np.int64), block.windows[kept]
        split = np.flatnonzero(hot[block.rank]) if some else np.empty(0, np.int64)
        if len(split):  # a context for each window, dealt by all its bytes
            times = block.windows[split]
            alone = np.repeat(split, times)
            step = np.arange(len(alone)) - np.repeat(np.cumsum(times) - times, times)
            kept, shift, windows = np.append(kept, alone), np.append(shift, step), np.append(windows, np.ones(len(alone), np.int64))
            bucket = np.append(bucket, (tk.string_hashes(block.data, block.begin[alone] + step, block.begin[alone] + step + length) % U(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            kept, shift, windows, bucket = kept[order], shift[order], windows[order], bucket[order]
        rows: list[tuple] = []
        for lo, hi in _edges(bucket):
            own = kept[lo:hi]
            size = windows[lo:hi] + length - 1
            where = np.repeat(block.begin[own] + shift[lo:hi] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            small = (x.astype(np.uint16) for x in (windows[lo:hi], block.elected[own] - shift[lo:hi], shift[lo:hi]))
            rows.append((int(bucket[lo]), key[0].as_py(), hi - lo, _squeeze(block.smallest[own], own.astype(np.uint32), *small, block.data[where])))
        return pa.table(list(zip(*rows, strict=True)) or [[], [], [], []], schema=schema)

    return run


def _groups(names: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (names, more) together, and where each group starts."""
    order = np.argsort(names)
    a, b = names[order], more[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((more, names))
        a, b = names[order], more[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def _names(data: np.ndarray, off: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names for each window of the contexts that begin at `off`, by doubling: 8, 16, 32 and at last `length` bytes."""
    names, at = (np.empty(windows.sum(), U), np.empty(windows.sum(), U)), 0
    for lo, hi in tk.runs(off):
        words = tk.mix(tk.eights(data[off[lo] : off[hi]]))
        many = windows[lo:hi]
        n = int(many.sum())
        spots = np.repeat(off[lo:hi] - off[lo] - (np.cumsum(many) - many), many) + np.arange(n)
        for seed, out in zip((101, 202), names, strict=True):
            name, size = words, 8
            while size < length:
                step = min(size, length - size)
                name, size = paired(name[:-step], name[step:], seed + size), size + step
            out[at : at + n] = tk.mix(name[spots])
        at += n
    return names


def _reranked(length: int):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("runs", pa.int64()), ("blob", pa.binary())])

    def run(key, rows):
        out: dict[str, list] = {"block": [], "bucket": [], "runs": [], "blob": []}
        held = []
        for block, n, blob in zip(rows["block"].to_pylist(), rows["contexts"].to_pylist(), rows["blob"], strict=True):
            raw = _expand(blob.as_py())
            number = lambda kind, at: np.frombuffer(raw, kind, n, at * n).astype(np.int64)  # noqa: B023, E731
            held.append((np.full(n, block), number(np.uint32, 8), number(np.int64, 0), number(np.uint16, 12), number(np.uint16, 14), number(np.uint16, 16), np.frombuffer(raw, np.uint8, offset=18 * n)))
        block, ordinal, docs, windows, elected, shift, data = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        sizes = windows + length - 1
        begin = np.cumsum(sizes) - sizes
        # rank 1: positions whose 16 bytes are unique drop out
        rank = data[(begin + elected)[:, None] + np.arange(KEY)].view(U)
        order, start = _groups(rank[:, 0].copy(), rank[:, 1].copy())
        count = np.diff(np.append(start, len(order)))
        keep = np.zeros(len(order), bool)
        keep[order] = np.repeat(count > 1, count)
        if not keep.any():
            return pa.table(out, schema=schema)
        data = data[np.repeat(keep, sizes)]
        block, ordinal, docs, windows, shift, sizes = (x[keep] for x in (block, ordinal, docs, windows, shift, sizes))
        begin = np.cumsum(sizes) - sizes
        names = _names(data, np.append(begin, len(data)), windows, length)
        of = np.repeat(np.arange(len(windows)), windows)
        order, start = _groups(*names)
        count = np.diff(np.append(start, len(order)))
        lowest = np.empty(len(order), np.int64)
        lowest[order] = np.repeat(np.minimum.reduceat(docs[of][order], start), count)
        hit = np.flatnonzero(lowest < docs[of])
        if not len(hit):
            return pa.table(out, schema=schema)
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > 1) | (of[hit][1:] != of[hit][:-1])
        lo = hit[np.flatnonzero(new)]
        hi = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
        entry = of[lo]
        zero = (np.cumsum(windows) - windows - shift)[entry]
        by = np.argsort(block[entry], kind="stable")
        edges = np.append(np.flatnonzero(np.diff(block[entry][by], prepend=-1)), len(by))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = by[a:b]
            out["block"].append(int(block[entry[mine[0]]]))
            out["bucket"].append(key[0].as_py())
            out["runs"].append(len(mine))
            out["blob"].append(_squeeze(ordinal[entry[mine]].astype(np.uint32), (lo - zero)[mine].astype(np.uint16), (hi - zero)[mine].astype(np.uint16)))
        return pa.table(out, schema=schema)

    return run


def _removed(block: Block, found: pa.Table) -> np.ndarray:
    """Where bytes of the block go."""
    length, change = block.length, np.zeros(len(block.data) + 1, np.int32)
    later = block.ids[block.text] > block.smallest[block.context] if len(block.text) else np.empty(0, bool)
    np.add.at(change, block.first[later], 1)
    np.add.at(change, block.last[later] + length, -1)
    own = np.flatnonzero(~later)
    by = np.argsort(block.context[own], kind="stable")
    own, of = own[by], block.context[own][by]
    for n, blob in zip(found["runs"].to_pylist(), found["blob"], strict=True):
        raw = _expand(blob.as_py())
        context = np.frombuffer(raw, np.uint32, n).astype(np.int64)
        lo, hi = np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.int64), np.frombuffer(raw, np.uint16, n, 6 * n).astype(np.int64)
        a, b = np.searchsorted(of, context), np.searchsorted(of, context, side="right")
        times = b - a
        spot = own[np.repeat(a - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        np.add.at(change, block.first[spot] + np.repeat(lo, times), 1)
        np.add.at(change, block.first[spot] + np.repeat(hi, times) + length, -1)
    return np.cumsum(change, out=change)[:-1] > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The removal shrunk to whole UTF-8 characters: a character goes if all its bytes do."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return gone
    return np.repeat(np.minimum.reduceat(gone, lead), np.diff(np.append(lead, len(data)))).astype(bool)


def _cleaned(length: int, buckets: int, with_text: bool):
    def run(key, docs, found):
        block = Block(docs, length, buckets)
        gone = _removed(block, found)
        docs, off, data = block.docs, block.off, block.data
        del block
        counts, digest, left = np.zeros((2, len(off) - 1), np.int64), [], []
        for begin, end in tk.runs(off):
            own = slice(off[begin], off[end])
            at = off[begin : end + 1] - off[begin]
            _, _, first = tk.spans(gone[own], at)
            counts[:, begin:end] = summed(gone[own], at[:-1], at[1:]), np.diff(first)
            text_gone = whole_characters(data[own], gone[own]) if with_text else None
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                text = data[own][lo:hi]
                digest.append(hashlib.sha256(text[~gone[own][lo:hi]].tobytes()).hexdigest())
                left.append(text[~text_gone[lo:hi]].tobytes().decode("utf-8", "replace") if with_text else None)
        columns = [pa.array(np.diff(off)), *(pa.array(x) for x in counts), pa.array(digest, pa.string()), pa.array(left, pa.string())]
        return pa.table([docs["rest"], *columns], names=["rest", *FOUND])

    return run


#: Columns that the operator adds, and their types.
FOUND = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_text": "string"}


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id and the other columns of docs but text, then FOUND.

    `kept_text` is what is left as whole characters (a character goes only if all of its bytes do); null without
    `with_text`.  A null doc_id ranks behind all others.  `length` is at least 48.  Columns of docs named like one of
    FOUND, in upper or lower case, are replaced; other names may be dotted, repeated, or alike but for case.
    """
    if length < 3 * KEY:
        raise ValueError(f"length is at least {3 * KEY}")
    small_batches(docs.sparkSession)
    named = columns(docs, "doc_id", "text")
    others = [(new, old) for new, old in zip(named.columns, docs.columns, strict=True) if new != "text" and old.lower() not in FOUND]
    plain = named.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank_id"), F.col("text").cast("string").alias("text"), F.struct(*(x for x, _ in others)).alias("rest"))
    _, size = text_bytes(plain)
    blocks, buckets = parts(size, BLOCK_BYTES), parts(size, BUCKET_BYTES)
    dealt = plain.select(F.pmod(F.xxhash64("rank_id"), F.lit(blocks)).alias("block"), "rank_id", "text", "rest")
    met = dealt.groupBy("block").applyInArrow(_ranks(length, buckets), RANKS).groupBy("bucket").applyInArrow(_met(HOT), RANKS)
    contexts = dealt.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_contexts(length, buckets), "bucket long, block long, contexts long, blob binary")
    found = contexts.groupBy("bucket").applyInArrow(_reranked(length), "block long, bucket long, runs long, blob binary")
    schema = T.StructType([T.StructField("rest", dealt.schema["rest"].dataType)])
    for name, kind in FOUND.items():
        schema = schema.add(name, kind)
    out = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cleaned(length, buckets, with_text), schema)
    return out.select(*(f"rest.{x}" for x, _ in others), *FOUND).toDF(*(x for _, x in others), *FOUND)
