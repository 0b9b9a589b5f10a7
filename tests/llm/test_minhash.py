import random

import pytest
from pyspark.sql import functions as F

from sluice.llm import minhash
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def edited(words, rng, n, vocabulary):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


def corpus(seed):
    """Groups around 0.8: copies with few and with many edits, exact copies, short texts, one hot group."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for size, edits in ((60, (0, 1, 2, 3)), (25, (1, 2, 3, 4)), (10, (0, 0, 1)), (6, (2, 5))):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((60, 120)))]
        for _ in range(size):
            rows.append(" ".join(edited(base, rng, rng.choice(edits), vocabulary)))
    rows += [rows[0]] * 12 + ["A b C", "a  B\tc", "a b", "", "  \n", "one"] + [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block", [(1, 8192), (2, 7)])
def test_components_match_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(seed)
    want, sets = brute.components(rows, 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit(1)).withColumn("band", F.lit("x")), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.component_id == r.doc_id) for r in got)


def test_block_search_finds_links_that_stars_miss(spark):
    """Chains around a bucket's center: neighbours are linked, ends are not."""
    words = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join([*words[: 100 - 4 * i], *[f"x{j}" for j in range(4 * i)]])) for i in range(8)]
    rng = random.Random(0)
    rng.shuffle(rows)
    want, _ = brute.components(rows, 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_nulls_and_repeated_rows(spark):
    rows = [(1, None), (2, None), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "z"), (4, "")]
    got = [tuple(r)[:4] for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 1, None, True), (4, 0, 4, True)], key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark):
    """Whole texts count: copies of 60 000 words with few and with many changes at their ends."""
    words = [f"w{i}" for i in range(60_000)]
    texts = [words, words[:-3_000] + [f"x{i}" for i in range(3_000)], words[:45_000] + [f"y{i}" for i in range(15_000)], ["one"] * 60_000]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, sets = brute.components(rows, 4)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (want[i], len(sets[i])) for i, _ in rows}
    assert [want[i] for i in range(4)] == [0, 0, 2, 3]


def test_texts_without_candidates_are_not_shuffled(spark):
    """Large tables are never broadcast; then only texts that are compared may travel: here 8 of 400, and a chain that needs the block search."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(100)]
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1500)) for _ in range(392)]
    texts += [" ".join([*words[: 100 - 4 * i], *[f"x{j}" for j in range(4 * i)]]) for i in range(8)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, _ = brute.components(rows, 4)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: r.component_id for r in got} == want
    written = sum(n for stage, n in shuffled().items() if stage not in before)
    assert 0 < written < 0.25 * sum(map(len, texts))
