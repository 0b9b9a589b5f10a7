"""Quality classifier: a generalised additive model with pairwise interactions.

Each text has a few numeric features (never a label, lang, source or doc_id).  Cyclic boosting visits the features in
turn; each visit fits a shallow tree on one feature's bins to the log-loss gradient and adds a part of it to that
feature's lookup table.  Then the pairs with the largest remaining gain get two-way tables in the same manner.  A
score is the sum of table entries at a text's bins, looked up for a whole batch at once.

The fit uses at most `sample` labelled rows, those with the smallest hash of doc_id; tables and bins are the model.
Defined results: null and empty texts are scored from their zero features; without rows of both labels every score is
the share of label 1 (0.5 without labelled rows); repeated rows are scored each, and of rows that share a labelled
doc_id one is learnt from; a null doc_id is not held out; between cuts of equal gain the lowest wins; very long texts
are worked on one at a time; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as tk
from sluice.llm.profile import EVERY, IS_DIGIT, IS_LEAD, IS_LETTER, IS_LOWER, IS_STOP, IS_SYMBOL, IS_UPPER, profile, summed
from sluice.llm.runtime import columns, small_batches

SAMPLE, BINS, PAIR_BINS, PAIRS = 12_000, 32, 12, 6
NAMES = [
    "log_chars", "log_words", "word_length", "upper", "lower", "digits", "symbols", "bars", "bangs", "stops", "other", "non_ascii",
    "distinct_words", "dup_lines", "repeat_words", "line_chars", "log_lines", "symbol_words", "bang_words", "commonest_word", "long_words", "line_stops",
]


def features(texts: tk.Texts) -> np.ndarray:
    """Texts x features."""
    p = profile(texts)
    data, n = p.data, texts.n
    count = lambda flag: (p.byte_counts @ flag.astype(np.int64)).astype(float)
    of_words = lambda flag: summed(flag, p.first[:-1], p.first[1:]).astype(float)
    chars, words = count(IS_LEAD), p.n_words.astype(float)
    size, some = np.maximum(count(~tk.is_space(EVERY)), 1), np.maximum(words, 1)
    text = np.repeat(np.arange(n), p.n_words)
    order = np.lexsort((p.hashes, text))
    h, t = p.hashes[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    start = np.flatnonzero(fresh)
    times = np.diff(np.append(start, len(h)))
    commonest = np.zeros(n)
    np.maximum.at(commonest, t[start], times)
    lines = np.bincount(p.lines.text, minlength=n).astype(float)
    last = data[np.maximum(p.ends - 1, 0)] if len(p.ends) else np.empty(0, np.uint8)
    line_last = data[np.maximum(p.lines.hi - 1, 0)] if len(p.lines.hi) else np.empty(0, np.uint8)
    other = (EVERY > 32) & (EVERY < 127) & ~IS_LETTER & ~IS_DIGIT & ~IS_STOP & ~IS_SYMBOL
    values = [
        np.log1p(chars), np.log1p(words), p.word_chars / some, count(IS_UPPER) / size, count(IS_LOWER) / size, count(IS_DIGIT) / size,
        p.n_symbols / size, count(EVERY == 124) / size, count(EVERY == 33) / size, count(IS_STOP) / size, count(other) / size, count(EVERY >= 128) / size,
        np.bincount(t[start], minlength=n) / some, p.n_dup_lines / np.maximum(lines, 1), p.n_repeat_words / some, chars / np.maximum(lines, 1), np.log1p(lines), of_words(IS_SYMBOL[last]) / some, of_words(last == 33) / some, commonest / some,
        of_words(p.ends - p.starts > 14) / some, np.bincount(p.lines.text, IS_STOP[line_last].astype(float), n) / np.maximum(lines, 1),
    ]
    return np.stack([np.asarray(c, float) for c in values], axis=1)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins: the best cut of any leaf, again and again."""
    g, w = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    leaf = [(0, len(gradient))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in leaf:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (a, b), int(cut[k]))
        if best[1] is None:
            break
        (a, b), cut = best[1], best[2]
        leaf = [x for x in leaf if x != (a, b)] + [(a, cut), (cut, b)]
    out = np.empty(len(gradient))
    for a, b in leaf:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    base: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, table)

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15) -> Model:
        share = (y.sum() + 1) / (len(y) + 2)
        model = cls(float(np.log(share / (1 - share))))
        if len(set(y.tolist())) < 2:
            return model
        cuts = lambda v, k: np.unique(np.quantile(v, np.arange(1, k) / k))
        model.edges = [cuts(v, BINS) for v in x.T]
        model.coarse = [cuts(v, PAIR_BINS) for v in x.T]
        bins = [np.searchsorted(e, v, side="right") for e, v in zip(model.edges, x.T, strict=True)]
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        total = np.full(len(y), model.base)
        for _ in range(rounds):
            for b, table in zip(bins, model.tables, strict=True):
                p = _sigmoid(total)
                step = rate * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
                table += step
                total += step[b]
        wide = [np.searchsorted(e, v, side="right") for e, v in zip(model.coarse, x.T, strict=True)]
        p, gains = _sigmoid(total), []
        for i in range(x.shape[1]):
            for j in range(i):
                cell = wide[i] * (len(model.coarse[j]) + 1) + wide[j]
                g, w = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
                gains.append((float((g**2 / (w + 3.0)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            model.pairs.append((i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))))
        for _ in range(rounds // 4):
            for i, j, table in model.pairs:
                p = _sigmoid(total)
                cell = wide[i] * table.shape[1] + wide[j]
                g, w = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
                step = rate * _two_way(g, w)
                table += step
                total += step[wide[i], wide[j]]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for edges, table, v in zip(self.edges, self.tables, x.T, strict=False):
            total += table[np.searchsorted(edges, v, side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return _sigmoid(total)


def _two_way(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A tree with one cut in each of two features: four leaves."""
    sums = [np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0))) for v in (g, w)]

    def quarter(s: np.ndarray) -> list[np.ndarray]:
        inner, right, below, whole = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return [inner, right - inner, below - inner, whole - right - below + inner]

    gs, ws = quarter(sums[0]), quarter(sums[1])
    if not gs[0].size:
        return np.zeros_like(g)
    gain = sum(a * a / (b + 3.0) for a, b in zip(gs, ws, strict=True))
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for k, spot in enumerate((np.s_[: r + 1, : c + 1], np.s_[: r + 1, c + 1 :], np.s_[r + 1 :, : c + 1], np.s_[r + 1 :, c + 1 :])):
        out[spot] = gs[k][r, c] / (ws[k][r, c] + 3.0)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in tk.slices(batches):
        x = features(texts)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs(doc_id, text), labels(doc_id, quality); rows whose crc32(doc_id) mod 3 is 1 are never read."""
    chosen = labels.filter(~held_out() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
    # At most `sample` rows of two numbers are broadcast, and as many come back: one row for each doc_id.
    rows = docs.join(F.broadcast(chosen), "doc_id").mapInArrow(_measure, "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("one")).select("doc_id", "one.*").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Model(0.0)
    return Model.fitted(np.array(rows["x"].to_pylist(), float), rows["quality"].to_numpy().astype(float))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tk.slices(batches):
            score = model.score(features(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    plain = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).mapInArrow(_scored(fit(plain, columns(labels, "doc_id", "quality"), sample)), "doc_id long, held_out boolean, score double, predicted int")
