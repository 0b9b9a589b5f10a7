"""Counts over whole texts and their lines, vectorised over a slice of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sluice.llm import textkit as tk

U = np.uint64
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


IS_SYMBOL = _flags(SYMBOLS)
IS_UPPER = _flags(bytes(range(65, 91)))
IS_LOWER = _flags(bytes(range(97, 123)))
IS_DIGIT = _flags(b"0123456789")
IS_STOP = _flags(b".,;:?")
EVERY = np.arange(256)
IS_LEAD = (EVERY & 0xC0) != 0x80
IS_LETTER = IS_UPPER | IS_LOWER | (IS_LEAD & (EVERY >= 128))


def summed(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[hi] - total[lo]


def byte_counts(texts: tk.Texts) -> np.ndarray:
    """Texts x 256: how often each byte occurs."""
    out = np.zeros((texts.n, 256), np.int64)
    for i, (lo, hi) in enumerate(zip(texts.off[:-1].tolist(), texts.off[1:].tolist(), strict=True)):
        if hi > lo:
            out[i] = np.bincount(texts.data[lo:hi], minlength=256)
    return out


@dataclass
class Lines:
    """Lines with a word: text index, first byte, end, words, and whether an earlier line of the text is equal."""

    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    words: np.ndarray
    repeated: np.ndarray


@dataclass
class Profile:
    data: np.ndarray
    off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    byte_counts: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: Lines


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Words of each text inside windows of `size` words that occur at least twice in that text."""
    n, texts = len(hashes), len(first) - 1
    counts = np.diff(first)
    windows = np.maximum(counts - size + 1, 0)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first[:-1], windows)
    text = np.repeat(np.arange(texts), windows)
    key = tk.mix(tk.grams(hashes, size)[at] + text.astype(U) * U(tk.MULTIPLIER)) if len(at) else np.empty(0, U)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    change[at[twice]] += 1  # starts are distinct, and so are ends
    change[at[twice] + size] -= 1
    return summed(np.cumsum(change[:-1]) > 0, first[:-1], first[1:])


def lines_of(texts: tk.Texts, starts: np.ndarray) -> Lines:
    data, off = texts.data, texts.off
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(off, breaks, side="right") - 1
    lo = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    hi = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    text = np.sort(np.concatenate([np.arange(texts.n), of_break]), kind="stable")
    words = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
    keep = words > 0
    lo, hi, text, words = lo[keep], hi[keep], text[keep], words[keep]
    repeated, raw, seen, last = np.zeros(len(lo), bool), data.tobytes(), set(), -1
    for i in np.flatnonzero(np.bincount(text, minlength=texts.n)[text] > 1).tolist():
        if text[i] != last:
            seen, last = set(), text[i]
        line = raw[lo[i] : hi[i]]
        repeated[i] = line in seen
        seen.add(line)
    return Lines(text, lo, hi, words, repeated)


def profile(texts: tk.Texts) -> Profile:
    data, off = texts.data, texts.off
    hashes, starts, ends, first = tk.word_hashes(texts, lower=False)
    lines, held = lines_of(texts, starts), byte_counts(texts)
    return Profile(
        data, off, starts, ends, first, hashes, held,
        n_words=np.diff(first),
        word_chars=held @ (IS_LEAD & ~tk.is_space(EVERY)).astype(np.int64),
        n_symbols=held @ IS_SYMBOL.astype(np.int64),
        n_dup_lines=np.bincount(lines.text[lines.repeated], minlength=texts.n).astype(np.int64),
        n_repeat_words=repeated_words(hashes, first, 8),
        lines=lines,
    )
