"""The pipeline against plain versions of its stages, each on the stage's own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import decontaminate, quality_rules
from sluice.llm.runtime import Scratch
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch, steps = Scratch(spark), {}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, DATA))
        steps[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    read = spark.read.parquet(f"{DATA}/documents.parquet")
    verdict = {r.doc_id: r for r in quality_rules.judge(read, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    counts = {r.doc_id: brute.quality_counts(r.text) for r in steps["documents"]}
    stays = {i for i, (n, _, _, _, again) in counts.items() if n >= 20 and 100 * again <= 30 * n and verdict[i].content_share >= quality_rules.CONTENT_SHARE}
    assert {r.doc_id for r in steps["quality_rules"]} == stays

    component, _ = brute.components([(r.doc_id, r.text) for r in steps["quality_rules"]], 5)
    assert sorted(map(tuple, steps["near_duplicates"])) == sorted(tuple(r) for r in steps["quality_rules"] if component[r.doc_id] == r.doc_id)

    left = {i: brute.whole_text(b, gone) for i, b, gone in brute.removed([(r.doc_id, r.text) for r in steps["near_duplicates"]], 50)}
    assert {r.doc_id: (r.text, r.n_chars) for r in steps["suffix_repeats"]} == {i: (t, len(t)) for i, t in left.items()}

    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in steps["suffix_repeats"] if not any(brute.overlapping(r.text, t, decontaminate.MASKS, decontaminate.SHORT_MASKS, decontaminate.WINDOW, decontaminate.EQUAL) for t in items if set(brute.lower(t).split()) & set(brute.lower(r.text).split()))}
    assert {r.doc_id for r in steps["decontamination"]} == clean
    assert {r.doc_id for r in steps["packing"]} == clean

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(tuple(r[c] for c in columns) for r in steps["packing"])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_shared_ids_lose_no_text(spark):
    """Near duplicates: every group keeps one row, the smallest id's; only texts decide, however many rows have no id or share one."""
    words = [f"w{i}" for i in range(40)]
    a, b, c, d, e = (" ".join(words[k:] + [f"x{k}"] * (k + 1)) for k in (0, 9, 17, 25, 33))
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (7, d), (9, e), (None, e), (5, e), (3, ""), (3, ""), (4, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate(spark, docs, DATA).collect()]
    want = [(None, a), (None, b), (7, c), (7, d), (5, e), (3, ""), (4, None), (None, ""), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_contaminated_rows_go_by_their_own_text(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after"), (None, "clean without an id"), (7, item), (7, "clean beside it"), (8, "clean")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, DATA).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_edge_rows_and_empty_tables(spark, name, stage):
    """Nulls in any column, empty, repeated and very long texts, and columns named alike but for case or like an operator's own."""
    long = " ".join(f"w{i}" for i in range(30_000))
    plain = "A plain sentence stands here, and it says what it has to say in words of its own. The next one goes on from there until the thought is done."
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, long, "en", None, None), (4, plain, "en", "s", 9), (4, plain, "en", "s", 9), (None, " \n\t ", "en", "s", 3), (5, "x" * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for extra in ("TEXT", "a.b", "row", "N_BYTES", "component", "_1", "kept"):
        docs = docs.withColumns({extra: F.lit("e")}) if extra != "TEXT" else docs.select("*", F.lit("e").alias("TEXT"))
    got = stage(spark, docs, DATA).collect()
    empty = stage(spark, docs.filter(F.lit(False)), DATA)
    assert empty.count() == 0
    if name == "packing":
        assert len({(r.doc_id, r.piece) for r in got}) >= len(rows) - 2 and sum(r.piece == 0 for r in got) == len(rows)
        return
    assert empty.columns == corpus_pipeline.COLUMNS
    texts = [(r.doc_id, r.text) for r in got]
    assert (3, long) in texts if name != "quality_rules" else all(len((t or "").split()) >= 20 for _, t in texts)
    assert (4, plain) in texts
    if name == "decontamination":
        assert sorted(texts, key=str) == sorted([(i, t) for i, t, *_ in rows], key=str)
    if name == "suffix_repeats":
        assert sorted(((i, t or "") for i, t in texts if i != 4), key=str) == sorted(((i, t or "") for i, t, *_ in rows if i != 4), key=str)
    if name == "near_duplicates":
        assert len(texts) == len(rows) - 1
