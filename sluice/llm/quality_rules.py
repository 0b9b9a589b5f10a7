"""Quality rules: counts of whole texts, and a linear-chain conditional random field over their lines.

The field labels every line that has a word content or boilerplate.  Its features are a few flags of the line.  Only
documents are labelled, so the labels of the sample's lines are latent (`learn`): a first fit without a chain takes
each line for its document's kind, and so learns how lines of either kind look; then lines take the label that the
field itself gives them, but for the least certain that must change so that the content share agrees with the
document's label, and the field is fitted to these, transitions included, and so on for `ROUNDS` rounds.  A plain line
in a junk document is thus content, a junk line in a good one boilerplate.  The fit is gradient ascent of the
conditional likelihood on a bounded sample of labelled documents (at most `sample` of each quality, those with the
smallest hash of doc_id).  Viterbi decoding gives the labels; the share of a text's word-bearing bytes on content lines
decides retention.

Defined results: a text without words fails the base rule; without labelled rows of both qualities every line is
content; between labels of equal score content wins; repeated rows are judged each, and of rows that share a labelled
doc_id one is learnt from; null text has no words; very long texts are worked on one at a time; other columns, whatever
their names, are ignored by `judge` and returned by `retained`.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as tk
from sluice.llm.profile import IS_DIGIT, IS_LETTER, IS_LOWER, IS_STOP, IS_SYMBOL, IS_UPPER, Profile, profile, summed
from sluice.llm.runtime import columns, small_batches

#: A document is kept if at least this share of it is content.
CONTENT_SHARE = 0.3
SAMPLE, ROUNDS = 1500, 3


def line_flags(p: Profile) -> np.ndarray:
    """0/1 features of each line; the first is always 1."""
    data, lines = p.data, p.lines
    lo, hi = lines.lo, lines.hi
    same = np.zeros(len(p.hashes), bool)
    same[1:] = p.hashes[1:] == p.hashes[:-1]
    stutter = summed(same, np.searchsorted(p.starts, lo), np.searchsorted(p.starts, hi))
    size = np.maximum(hi - lo, 1)
    letters = np.maximum(summed(IS_LETTER[data], lo, hi), 1)
    upper, lower = summed(IS_UPPER[data], lo, hi), summed(IS_LOWER[data], lo, hi)
    symbols, bars, bangs = summed(IS_SYMBOL[data], lo, hi), summed(data == 124, lo, hi), summed(data == 33, lo, hi)
    digits, stops = summed(IS_DIGIT[data], lo, hi), summed(IS_STOP[data], lo, hi)
    words = lines.words
    last = data[np.maximum(hi - 1, 0)] if len(data) else np.empty(0, np.uint8)
    flags = [
        np.ones(len(lo), bool),
        size < 25,
        size >= 80,
        size >= 300,
        words == 1,
        symbols * 50 > size,
        symbols * 10 > size,
        upper * 2 > letters,
        (upper > lower) & (words > 3),
        bars * 4 > words,
        bangs * 4 > words,
        digits * 4 > size,
        stops == 0,
        stops * 20 > words,
        IS_STOP[last],
        lines.repeated,
        letters > 14 * words,
        letters < 3 * words,
        (symbols == 0) & (upper * 2 < letters) & (bars == 0) & (bangs * 20 < words) & (words >= 4),
        stutter * 4 > words,
    ]
    return np.stack(flags, axis=1).astype(np.float64) if len(lo) else np.zeros((0, len(flags)))


N_FLAGS = 20


class Sequences:
    """Lines of documents laid end to end, the longest document first by `begin` and `alive`, for all to advance at once."""

    def __init__(self, length: np.ndarray, weight: np.ndarray):
        order = np.argsort(-length, kind="stable")
        self.first = np.append(0, np.cumsum(length))
        self.begin = self.first[:-1][order]
        self.alive = [int((length > t).sum()) for t in range(int(length.max()))]
        self.document = np.repeat(np.arange(len(length)), length)
        self.weight = (weight / length / weight.sum())[self.document]


def agreeing(margin: np.ndarray, size: np.ndarray, lines: Sequences, quality: np.ndarray, least: float) -> np.ndarray:
    """Labels of lines: the sign of the margin, the least certain changed until each document's content share fits its quality."""
    label = (margin >= 0).astype(np.int64)
    whole = np.bincount(lines.document, size)
    share = np.bincount(lines.document, size * label) / whole
    for d in np.flatnonzero((share >= least) != (quality == 1)).tolist():
        lo, hi = lines.first[d], lines.first[d + 1]
        wrong = 1 - int(quality[d])
        held = share[d] * whole[d]
        for i in (np.argsort(np.abs(margin[lo:hi]), kind="stable") + lo).tolist():
            if label[i] == wrong:
                label[i] = 1 - wrong
                held += size[i] if wrong == 0 else -size[i]
                if (held >= least * whole[d]) == (wrong == 0):
                    break
    return label


def learn(flags: np.ndarray, length: np.ndarray, size: np.ndarray, quality: np.ndarray, least: float) -> Field:
    """The field from documents' qualities, the labels of their lines being latent."""
    lines = Sequences(length, np.where(quality == 1, 0.5 / (quality == 1).sum(), 0.5 / (quality == 0).sum()))
    blank = Field(np.zeros((N_FLAGS, 2)), np.zeros((2, 2)))
    field = blank.fitted(flags, lines, quality[lines.document], chain=False)
    for _ in range(ROUNDS):
        _, forward, backward, _ = field.beliefs(flags, lines)
        both = forward + backward
        field = field.fitted(flags, lines, agreeing(both[:, 1] - both[:, 0], size, lines, quality, least), chain=True)
    return field


class Field:
    """Weights: emission (flags x 2) and transition (2 x 2); state 1 is content."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    @classmethod
    def neutral(cls) -> Field:
        emission = np.zeros((N_FLAGS, 2))
        emission[0, 1] = 1.0
        return cls(emission, np.zeros((2, 2)))

    def beliefs(self, flags: np.ndarray, lines: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, forward and backward sums of each line and state, and each line's total, all as logarithms."""
        score = flags @ self.emission
        forward, backward, transition = np.empty_like(score), np.zeros_like(score), self.transition
        for t, n in enumerate(lines.alive):
            at = lines.begin[:n] + t
            forward[at] = score[at] if t == 0 else score[at] + np.logaddexp(forward[at - 1, 0, None] + transition[0], forward[at - 1, 1, None] + transition[1])
        for t in range(len(lines.alive) - 2, -1, -1):
            at = lines.begin[: lines.alive[t + 1]] + t
            ahead = score[at + 1] + backward[at + 1]
            backward[at] = np.stack([np.logaddexp(transition[s, 0] + ahead[:, 0], transition[s, 1] + ahead[:, 1]) for s in (0, 1)], axis=1)
        return score, forward, backward, np.logaddexp(*(forward + backward).T)

    def fitted(self, flags: np.ndarray, lines: Sequences, label: np.ndarray, chain: bool, steps: int = 60) -> Field:
        """Gradient ascent from these weights to the lines' labels; without `chain` transitions stay as they are."""
        emission, transition = self.emission.copy(), self.transition.copy()
        gold = np.zeros((len(flags), 2))
        gold[np.arange(len(flags)), label] = 1
        inner = np.ones(len(flags), bool)
        inner[lines.begin] = False
        at = np.flatnonzero(inner)
        speed_e, speed_t = np.zeros_like(emission), np.zeros_like(transition)
        for _ in range(steps):
            score, forward, backward, total = Field(emission, transition).beliefs(flags, lines)
            belief = np.exp(forward + backward - total[:, None])
            step_e = flags.T @ ((gold - belief) * lines.weight[:, None]) - 1e-3 * emission
            speed_e = 0.9 * speed_e + step_e
            if chain:
                step_t = np.empty((2, 2))
                for a in (0, 1):
                    for b in (0, 1):
                        pair = np.exp(forward[at - 1, a] + transition[a, b] + score[at, b] + backward[at, b] - total[at])
                        step_t[a, b] = ((gold[at - 1, a] * gold[at, b] - pair) * lines.weight[at]).sum()
                speed_t = 0.9 * speed_t + step_t - 1e-2 * transition
                transition = transition + 0.5 * speed_t
            emission = emission + 0.5 * speed_e
        return Field(emission, transition)

    def decode(self, flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi: 1 for content, for the lines of each text (first: where each text's lines begin, and the end)."""
        score = (flags @ self.emission).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        out = np.zeros(len(score), np.int8)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b = score[lo]
            back = []
            for x, y in score[lo + 1 : hi]:
                from_a, from_b = a + t00 >= b + t10, a + t01 > b + t11
                back.append((from_a, from_b))
                a, b = (a + t00 if from_a else b + t10) + x, (a + t01 if from_b else b + t11) + y
            state = 1 if b >= a else 0
            out[hi - 1] = state
            for i in range(hi - lo - 2, -1, -1):
                from_a, from_b = back[i]
                state = (0 if from_b else 1) if state else (0 if from_a else 1)
                out[lo + i] = state
        return out


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _judge(field: Field, least: float, whole_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tk.slices(batches):
            p = profile(texts)
            lines = p.lines
            first = np.searchsorted(lines.text, np.arange(texts.n + 1))
            label = field.decode(line_flags(p), first)
            size = (lines.hi - lines.lo).astype(np.float64)
            whole = np.bincount(lines.text, size, texts.n)
            share = np.bincount(lines.text, size * label, texts.n) / np.maximum(whole, 1)
            failed = (p.n_words < 20) | (100 * p.n_repeat_words > 30 * p.n_words)
            kept = ~failed & (share >= least)
            if whole_rows:
                yield part.filter(pa.array(kept))
                continue
            out = [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words)), pa.array(failed), pa.array(kept), pa.array(share)]
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in COLUMNS.split(", ")])

    return run


FLAGGED = "doc_id long, quality int, lines long, flags binary, sizes binary"


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's lines as packed flags, and their bytes: what fitting needs of a text."""
    for part, texts in tk.slices(batches):
        p = profile(texts)
        flags = line_flags(p).astype(np.uint8)
        size = (p.lines.hi - p.lines.lo).astype("<u4")
        first = np.searchsorted(p.lines.text, np.arange(texts.n + 1))
        spans = list(zip(first[:-1], first[1:], strict=True))
        out = [part.column("doc_id"), part.column("quality"), pa.array(np.diff(first), pa.int64()), *(pa.array([f(lo, hi) for lo, hi in spans], pa.binary()) for f in (lambda lo, hi: np.packbits(flags[lo:hi]).tobytes(), lambda lo, hi: size[lo:hi].tobytes()))]  # noqa: B023
        yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in FLAGGED.split(", ")])


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = CONTENT_SHARE) -> Field:
    """The field for `labels`(doc_id, quality): a bounded sample, see the module's text."""
    known = columns(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(sample) for q in (0, 1)]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most two times `sample` rows of two numbers are broadcast, and as many come back: one row for each doc_id.
    rows = plain.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").mapInArrow(_flagged, FLAGGED)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lines", "flags", "sizes", "quality")).alias("one")).select("doc_id", "one.*").toArrow().sort_by("doc_id")
    rows = rows.filter(pa.compute.greater(rows["lines"], 0))
    length, quality = rows["lines"].to_numpy(), rows["quality"].to_numpy().astype(np.int64)
    if len(set(quality.tolist())) < 2:
        return Field.neutral()
    flags = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n * N_FLAGS).reshape(n, N_FLAGS) for x, n in zip(rows["flags"], length.tolist(), strict=True)]).astype(float)
    size = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows["sizes"]]).astype(float)
    return learn(flags, length, size, quality, least)


def judge(docs: DataFrame, labels: DataFrame, least: float = CONTENT_SHARE) -> DataFrame:
    """docs(doc_id, text, ...) -> COLUMNS."""
    small_batches(docs.sparkSession)
    plain = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_judge(fit_field(plain, labels, least=least), least, False), COLUMNS)


def retained(docs: DataFrame, labels: DataFrame, least: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    small_batches(docs.sparkSession)
    plain = columns(docs, "doc_id", "text")
    return plain.mapInArrow(_judge(fit_field(plain, labels, least=least), least, True), plain.schema).toDF(*docs.columns)
