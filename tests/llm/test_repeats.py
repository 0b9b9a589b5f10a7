import random
import tracemalloc

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from sluice.llm import repeats
from sluice.llm import textkit as tk
from tests.llm import brute

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "HOT", 256 if seed == 0 else seed)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 700)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 900)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé \n日") for _ in range(n)) for n in (10, 60, 100, 300, 55)] + ["a" * 200, "ab" * 100]
    rows = []
    for i in range(40):
        text = ""
        for _ in range(rng.randrange(5)):
            x = rng.choice(pool)
            text += x if rng.random() < 0.5 else x[rng.randrange(len(x)) :]
            text += "".join(rng.choice("abcdefgh") for _ in range(rng.choice((0, 20))))
        rows.append((i, text if rng.random() < 0.95 else None))
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(3)).withColumn("rest", F.lit("r")), 50).collect()}
    assert len(got) == len(rows)
    for i, b, gone in brute.removed(rows, 50):
        r = got[i]
        assert (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == brute.removal_row(i, b, gone)
        assert r.kept_text == brute.whole_text(b, gone) and (r.block, r.rest) == (3, "r")


def test_hot_passage_and_ties(spark):
    passage = "the very common passage that a third of all the documents holds in full " * 2
    rows = [(i, f"{i} own start {passage} own end {i}") for i in range(200)] + [(7, f"7 own start {passage} own end 7"), (None, passage)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), 50).collect()
    assert sum(r.n_removed > 0 for r in got) == 201  # all but doc 0; the repeated row 7 loses the passage only
    assert {(r.n_removed, r.n_spans) for r in got if r.doc_id == 7} == {(len(f" own start {passage} own end "), 1)}
    assert [r.kept_text for r in got if r.doc_id is None] == [""]


def test_hot_phrases_in_different_surroundings(spark, monkeypatch):
    """Phrases shorter than the length, common to all texts, bring no bucket more than its share, and remove nothing."""
    rng = random.Random(8)
    other = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for phrase in ("a phrase of twenty-nine bytes", "a much longer phrase, of nearly fifty bytes in all"[:48]):
        rows = [(i, f"{other(60)}{phrase}{other(60)}") for i in range(3000)]
        monkeypatch.setattr(repeats, "HOT", 3)
        held = []
        plain = pa.table({"rank_id": [i for i, _ in rows], "text": [t for _, t in rows], "rest": [None] * len(rows)})
        tables = [plain.slice(k * 300, 300) for k in range(10)]
        key = lambda k: (pa.scalar(k),)
        ranks = pa.concat_tables(repeats._ranks(50, 64)(key(k), t) for k, t in enumerate(tables))
        masks = pa.concat_tables(repeats._met(3)(None, ranks.filter(pa.compute.equal(ranks["bucket"], b))) for b in range(64) if pa.compute.any(pa.compute.equal(ranks["bucket"], b)).as_py())
        for k, t in enumerate(tables):
            held.append(repeats._contexts(50, 64)(key(k), t, masks.filter(pa.compute.equal(masks["block"], k))))
        sizes = pa.concat_tables(held).group_by("bucket").aggregate([("contexts", "sum")])["contexts_sum"].to_pylist()
        assert not sizes or max(sizes) <= 3 * (sum(sizes) / 64) + 20
        docs = spark.createDataFrame(rows[:200], SCHEMA).withColumn("N_BYTES", F.lit(1)).withColumn("a.b", F.lit(2)).select("*", F.lit(3).alias("A.b"))
        got = repeats.remove_repeats(docs, 50)
        assert got.columns == ["doc_id", "a.b", "A.b", *repeats.FOUND]
        want = {i: sum(gone) for i, _, gone in brute.removed(rows[:200], 50)}
        assert {r.doc_id: r.n_removed for r in got.collect()} == want


def in_process(rows, blocks, buckets):
    """What the operator's functions return for rows dealt into blocks in turn, and the most bytes that numpy and Python held meanwhile, inputs aside."""
    docs = pa.table({"rank_id": [i for i, _ in rows], "text": [t for _, t in rows], "rest": [i for i, _ in rows]})
    tables = [docs.take([i for i in range(len(rows)) if i % blocks == k]) for k in range(blocks)]
    key = lambda k: (pa.scalar(k),)
    of = lambda table, name, k: table.filter(pa.compute.equal(table[name], k))
    tracemalloc.start()
    try:
        ranks = pa.concat_tables(repeats._ranks(50, buckets)(key(k), t) for k, t in enumerate(tables))
        masks = pa.concat_tables(repeats._met(256)(None, of(ranks, "bucket", b)) for b in set(ranks["bucket"].to_pylist()))
        contexts = pa.concat_tables(repeats._contexts(50, buckets)(key(k), t, of(masks, "block", k)) for k, t in enumerate(tables))
        found = pa.concat_tables(repeats._reranked(50)(key(b), of(contexts, "bucket", b)) for b in set(contexts["bucket"].to_pylist()))
        out = pa.concat_tables(repeats._cleaned(50, buckets, True)(key(k), t, of(found, "block", k)) for k, t in enumerate(tables))
        return {r["rest"]: r for r in out.to_pylist()}, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("size", [1, 150, 1000])
def test_slices_of_a_block_agree_with_brute_force(monkeypatch, size):
    monkeypatch.setattr(tk, "SLICE_BYTES", size)
    rng = random.Random(size)
    pool = ["".join(rng.choice("abé \n日") for _ in range(n)) for n in (60, 100, 300, 55)]
    rows = [(i, rng.choice([None, "", "x"]) if i % 9 == 0 else "".join(rng.choice(pool) + "".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(rng.randrange(1, 4)))) for i in range(40)]
    got, _ = in_process(rows, 3, 4)
    for i, b, gone in brute.removed(rows, 50):
        r = got[i]
        assert (i, *(r[x] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))) == brute.removal_row(i, b, gone)
        assert r["kept_text"] == brute.whole_text(b, gone)


def test_work_on_a_block_takes_bounded_memory():
    """Two full blocks, of which each text's second half is a copy: arrays of 64-bit numbers stand for a slice of a block, never for all its bytes."""
    rng = random.Random(5)
    half = [rng.randbytes(2048).hex() for _ in range(1024)]
    rows = [(i, rng.randbytes(2048).hex() + half[i // 2]) for i in range(1024)]
    in_process(rows[:8], 2, 4)  # tables of powers and the like are made
    got, most = in_process(rows, 2, 4)
    assert sum(r["n_removed"] for r in got.values()) >= 512 * 4096
    assert most < 32 * repeats.BLOCK_BYTES


def test_empty_table_and_short_length(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], SCHEMA), 20)
