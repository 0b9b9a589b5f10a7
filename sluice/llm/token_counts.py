"""Token counts of a unigram tokenizer without building tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary gives every piece that ends at each place of a word.  Dynamic
programming carries, for each place, only the best score and the number of pieces on that path.  Ties go as in the
tokenizer: candidates for a place are tried from the earliest start on, and a later one wins only if it is strictly
better.  A character that is no piece costs the lowest score less 10 and falls back to one token for each byte.

Pieces never reach over a word's mark (U+2581), so a text's count is the sum over its words, and words seen lately
keep their counts.  Defined results: null and empty texts have no tokens; repeated rows are counted each; of paths of
equal score the one found first stands; very long texts are counted word after word; other columns, whatever their
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as tk
from sluice.llm.runtime import columns, small_batches

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words of each of the two generations whose counts a worker keeps, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 250_000, 64
COLUMNS = "doc_id long, n_words long, n_tokens long, n_fallback long, score double"


@lru_cache(maxsize=2)
def vocabulary(name: str) -> list[tuple[str, float]]:
    """The pieces of a vocabulary file in order; scores follow Zipf's law of the rank, normalised to a distribution."""
    import public_tokenizers as files
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=files.path(f"{name}.model"))
    n = model.get_piece_size()
    total = math.log(sum(1 / (rank + 1) for rank in range(n)))
    return [(model.id_to_piece(i), -math.log(i + 1) - total) for i in range(n)]


class Counter:
    """Counts for words that begin with MARK."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.kept: dict[str, tuple[int, int, float]] = {}
        self.older: dict[str, tuple[int, int, float]] = {}

    def count(self, word: str) -> tuple[int, int, float]:
        """Tokens, tokens of these by byte fallback, and the score."""
        scores, counts, fallback = [0.0], [0], [0]
        unknown, place = self.unknown, 0  # scores, counts and fallback are final up to `place`
        best, tokens, bytes_, single = None, 0, 0, True

        def close(until: int) -> None:
            """Make the places from the open one to `until` final; those without matches are unknown characters."""
            nonlocal best, tokens, bytes_, single, place
            while place < until:
                if place and not single:
                    candidate = unknown + scores[place - 1]
                    if best is None or candidate > best:
                        size = len(word[place - 1].encode("utf-8", "surrogatepass"))
                        best, tokens, bytes_ = candidate, counts[place - 1] + size, fallback[place - 1] + size
                if place:
                    scores.append(best)
                    counts.append(tokens)
                    fallback.append(bytes_)
                place += 1
                best, tokens, bytes_, single = None, 0, 0, False

        for end, (length, score) in self.automaton.iter(word):  # by end; for one end the longest, so the earliest start, first
            if end + 1 != place:
                close(end + 1)
            start = place - length
            candidate = score + scores[start]
            if best is None or candidate > best:
                best, tokens, bytes_ = candidate, counts[start] + 1, fallback[start]
            if length == 1:
                single = True
        close(len(word) + 1)
        return counts[-1], fallback[-1], scores[-1]

    def text(self, text: str) -> tuple[int, int, int, float]:
        if not text:
            return 0, 0, 0, 0.0
        words = text.replace(" ", MARK).split(MARK)
        if len(words) > 1 and not words[0]:  # the text begins with a mark of its own
            words = words[1:]
        tokens, fallback, score, kept = 0, 0, 0.0, self.kept
        for word in words:
            found = kept.get(word)
            if found is None:
                found = self.older.get(word) or self.count(MARK + word)
                if len(word) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_WORDS:
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[word] = found
            tokens += found[0]
            fallback += found[1]
            score += found[2]
        return len(words), tokens, fallback, score


@lru_cache(maxsize=1)
def _counter(name: str) -> Counter:
    return Counter(vocabulary(name))


def _counted(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name)
        for part, texts in tk.slices(batches):
            rows = [counter.text(texts.raw(i).decode("utf-8", "replace")) for i in range(texts.n)]
            found = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in found[:3]), pa.array(found[3], pa.float64())], [x.split()[0] for x in COLUMNS.split(", ")])

    return run


def count_tokens(docs: DataFrame, name: str = "piece_bpe_32k") -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_tokens, n_fallback, score."""
    small_batches(docs.sparkSession)
    return columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted(name), COLUMNS)
