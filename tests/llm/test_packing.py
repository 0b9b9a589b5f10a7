import zlib

import numpy as np
import public_tokenizers as files
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm.packing import WEIGHTS, opened, pack, plan, tightest

SCHEMA = "doc_id long, text string"


def test_pieces_and_places(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "hello <|endoftext|> world", "word " * 3000, "日本 😀\n\n" * 400, " " * 5000, "x" * 9000] + [f"short text number {i}" * (i % 40) for i in range(200)])] + [(2, "a"), (None, "no id")]
    got = pack(spark.createDataFrame(rows, SCHEMA)).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    exact = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    for i, text in rows[:-2]:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))[:: 2 if i == 2 else 1]
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 1024 for r in pieces[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= 1024
    assert len(by_doc[2]) == 2 and len(by_doc[None]) == 1
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 1024) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_is_sequential_best_fit(rule):
    """The histogram plan opens as many sequences as placing one item after another, and keeps every capacity."""
    rng = np.random.default_rng(5)
    for documents, cost in ((64, 64 * 64), (3, 64 * 64), (64, 1500)):
        lengths = rng.integers(1, 33, 300)
        rows = plan({int(v): int(n) for v, n in zip(*np.unique(lengths, return_counts=True), strict=True)}, 64, documents, cost, rule)
        held = {}
        for length, rank, n, first, offset in rows.tolist():
            for s in range(first, first + n):
                own = held.setdefault(s, [])
                assert sum(own) == offset
                own.append(length)
        assert sorted(x for own in held.values() for x in own) == sorted(lengths.tolist())
        assert all(sum(o) <= 64 and len(o) <= documents and sum(x * x for x in o) <= cost for o in held.values())
        whole = np.array([64, documents, cost])
        weight = np.array(WEIGHTS) / whole
        bins = []
        for length in sorted(lengths.tolist(), reverse=True):
            item = np.array([length, 1, length * length])
            fits = [b for b in range(len(bins)) if (bins[b] >= item).all()]
            if not fits:
                bins.append(whole - item)
                continue
            score = [(((bins[b] - item) * weight) ** 2).sum() if rule == "norm" else -(bins[b] * weight * item * weight).sum() for b in fits]
            bins[fits[int(np.argmin(score))]] -= item
        assert abs(len(held) - len(bins)) <= (0 if rule == "norm" else 1)


def test_document_and_cost_capacity_bind(spark):
    """Through pack(): fewer documents or less cost a sequence make another plan, and every sequence keeps within them."""
    docs = spark.createDataFrame([(i, "word " * (1 + i * 7 % 90)) for i in range(300)], SCHEMA).select("*", F.lit(1).alias("a.b"), F.lit(2).alias("TEXT"))
    sequences = {}
    for documents, cost in ((None, None), (64, None), (5, None), (None, 9000)):
        held = {}
        for r in pack(docs, 64, documents, cost).collect():
            held.setdefault(r.sequence_id, []).append(r.length)
        sequences[documents, cost] = len(held)
        assert all(sum(x) <= 64 and len(x) <= (documents or 64) and sum(n * n for n in x) <= (cost or 4096) for x in held.values())
    assert sequences[None, None] == sequences[64, None] < sequences[5, None] + 1


def test_the_chosen_document_capacity_binds_and_costs_nothing():
    rng = np.random.default_rng(3)
    for low, high in ((1, 9), (1, 64), (20, 64), (2, 3)):
        counts = {int(v): int(n) for v, n in zip(*np.unique(rng.integers(low, high, 2000), return_counts=True), strict=True)}
        free, bound = plan(counts, 64, 64, 4096), tightest(counts, 64, 4096, "norm")
        assert opened(bound) == opened(free)
        most = lambda rows: max(np.bincount(np.concatenate([np.arange(f, f + n) for _, _, n, f, _ in rows.tolist()])))
        assert most(bound) <= most(free)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0
