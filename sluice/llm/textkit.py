"""Words and hashes of whole texts, vectorised over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer text is a slice of its own.  Work arrays take some 100 bytes for each.
SLICE_BYTES = 512 << 10
MULTIPLIER = 0x9E3779B97F4A7C15
U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(MULTIPLIER) + U(seed))


BYTE_CODES = stream(256, 71) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word that are hashed by columns; longer words are hashed one by one.
WORD_BYTES = 64


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 to the 64th."""
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    out = []
    for base in (MULTIPLIER, inverse):
        table, filled = np.ones(size, U), 1
        while filled < size:
            step = min(filled, size - filled)
            table[filled : filled + step] = table[:step] * U(pow(base, filled, 1 << 64))
            filled += step
        out.append(table)
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    least = SLICE_BYTES + 1
    return _powers(least if size <= least else 1 << (size - 1).bit_length())


class Texts:
    """Bytes of consecutive texts; `off` has where each begins, and the end.  Null texts are empty."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        _, at, held = column.buffers()
        self.n = len(column)
        if self.n:
            off = np.frombuffer(at, np.int64)[column.offset : column.offset + self.n + 1]
            self.off = off - off[0]
            self.data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None and off[-1] > off[0] else np.empty(0, np.uint8)
        else:
            self.off, self.data = np.zeros(1, np.int64), np.empty(0, np.uint8)

    def raw(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def runs(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts that hold about SLICE_BYTES, or one longer text: the first, and the one past the last."""
    begin = 0
    while begin < len(off) - 1:
        end = max(int(np.searchsorted(off, off[begin] + SLICE_BYTES, side="right")) - 1, begin + 1)
        yield begin, end
        begin = end


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of rows that hold about SLICE_BYTES of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = Texts(batch.column(column))
        for begin, end in runs(whole.off):
            part = batch.slice(begin, end - begin)
            yield part, Texts(part.column(column))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs where `inside` holds, never across texts: starts, ends, and where each text's runs begin."""
    n = len(inside)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[off[:-1][off[:-1] < n]] = False
        after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number; past the end there are zeros."""
    x = np.zeros(len(data) + 8, U)
    x[: len(data)] = data
    for shift in (1, 2, 4):
        x[:-shift] |= x[shift:] << U(8 * shift)
    return x[: len(data)]


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes: its length, then eight bytes after eight, each mixed before the next is added."""
    size = ends - starts
    out = mix(size.astype(U) + U(MULTIPLIER))
    words = eights(data)
    at = np.flatnonzero((size > 0) & (size <= WORD_BYTES))
    k = 0
    while len(at):
        left = size[at] - k
        chunk = words[starts[at] + k]
        short = left < 8
        chunk[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
        out[at] = mix((out[at] ^ chunk) * U(MULTIPLIER) + U(k + 1))
        k += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > WORD_BYTES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_hashes(texts: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space (space and 09 to 0D): their hashes, starts, ends, and where each text's words begin."""
    data = texts.data
    starts, ends, first = spans(~is_space(data), texts.off)
    return string_hashes(LOWER[data] if lower else data, starts, ends), starts, ends, first


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k consecutive hashes, texts disregarded: one for each start but the last k - 1."""
    n = max(len(hashes) - k + 1, 0)
    acc = hashes[:n].copy()
    for t in range(1, k):
        acc = mix(acc * U(MULTIPLIER) + hashes[t : t + n])
    return acc


def shingle_sets(texts: Texts, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of fewer words the one whole sequence."""
    hashes, _, _, first = word_hashes(texts)
    all_grams = grams(hashes, k)
    for i in range(texts.n):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= k:
            yield np.unique(all_grams[lo : hi - k + 1])
        elif hi > lo:
            yield grams(hashes[lo:hi], hi - lo) ^ U(hi - lo)
        else:
            yield np.empty(0, U)
