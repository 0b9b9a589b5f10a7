import itertools
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from sluice.llm import decontaminate, licenses, token_counts
from tests.llm import brute

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def test_license_base(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "MIT  license; cc-BY, gnu General\nPUBLIC license apache License apache license"), (-4, "mitİ license mit licensee"), (-5, "cc by " * 500), (-1, None)]
    both = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumn("row", F.lit(1)).withColumn("words", F.lit(2))
    got = licenses.scan(both).collect()
    texts = {r.doc_id: r.text for r in both.collect()}
    assert len(got) == docs.count() + len(odd)
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    for r in got:
        w = brute.ALNUM.findall(brute.lower(texts[r.doc_id]))
        hits = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        base = sorted({label for _, label in hits})
        want = (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(base))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        labels = r.labels.split(",") if r.labels else []
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1


def test_license_diagonals(spark):
    text = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    words = text.split()
    with_gap = " ".join([*words[:10], "inserted", *words[10:25], *words[26:]])
    rows = [(1, f"code {text} more"), (2, with_gap), (3, " ".join(words[:8])), (4, " ".join(words[::-1])), (5, text.upper())]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["bsd", "bsd", "", "", "bsd"]
    assert got[1].score == 1.0 and got[1].spans[0].lo == 1 and 0.5 <= got[2].score < 1


def test_license_near_variants(spark):
    """Notices that differ by a word get the label of their own words only."""
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    cases = [
        (cc.format(""), "cc-by"), (cc.format("-NonCommercial"), "cc-by-nc"), (cc.format("-ShareAlike"), "cc-by-sa"), (cc.format("-NoDerivatives"), "cc-by-nd"), (cc.format("-Non-Commercial"), "cc-by-nc"),
        (cc.format("-NonCommercial-ShareAlike"), "cc-by-nc-sa"), (cc.format("-NonCommercial-NoDerivatives"), "cc-by-nc-nd"), (cc.format("-No-Derivs"), "cc-by-nd"),
        (f"{cc.format('')} NonCommercial uses and {cc.format('')}", "cc-by"), (f"{cc.format('')} {cc.format('-ShareAlike')}", "cc-by,cc-by-sa"),
        (gnu.format(""), "gpl"), (gnu.format("Lesser "), "lgpl"), (gnu.format("Affero "), "agpl"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), ("Licensed under CC BY-NC-ND 4.0.", "cc-by,cc-by-nc-nd"),
        ("It is not licensed under the GNU licence but was released under the MIT", ""), ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
        (f"{gnu.format('')} {gnu.format('Lesser ')} {cc.format('')}", "cc-by,gpl,lgpl"), (cc.format("") + " licensed under a creative commons" * 9, "cc-by"),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], SCHEMA)).collect()
    assert [r.labels for r in sorted(got)] == [want for _, want in cases]


def test_licenses_of_an_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "the MIT license " * 40_000)], SCHEMA).select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("a.b"))
    assert [(r.n_base, r.labels) for r in licenses.scan(odd).collect()] == [(40_000, "mit")]


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((9, 14, 20, 35, 40, 8, 3))] + [(7, None), (8, "")]
    docs = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if i % 2:
            item = (items[i % 7][1] or "").split()
            for _ in range(rng.randrange(6)):
                item[rng.randrange(len(item))] = "other"
            at = rng.randrange(len(body) + 1)
            body[at:at] = item
        docs.append((i, " ".join(body).upper() if i % 3 else ", ".join(body)))
    docs += [(60, None), (61, ""), (1, docs[1][1])]
    want = {(d, i) for d, t in docs for i, item in items if brute.overlapping(t, item, decontaminate.MASKS, decontaminate.SHORT_MASKS, decontaminate.WINDOW, decontaminate.EQUAL)}
    frames = spark.createDataFrame(docs, SCHEMA).withColumn("item_id", F.lit(5)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = decontaminate.overlaps(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 10
    left = decontaminate.without_overlaps(*frames)
    assert left.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_on_large_benchmarks_is_not_broadcast(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.overlaps(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_HITS", 0)
    assert sorted(map(tuple, decontaminate.overlaps(docs, items).collect())) == want and len(want) > 10


def test_one_substitution_hides_no_item(spark):
    """Of items of nine words and more every one is found whichever word is another; of those with two others in 13 words nearly all."""
    items = [(n, " ".join(f"{n}x{j}" for j in range(n))) for n in range(9, 20)]
    docs, want = [], set()
    for n, text in items:
        for e in range(n):
            docs.append((len(docs), " ".join(["before", *text.split()[:e], "other", *text.split()[e + 1 :], "After"])))
            want.add((len(docs) - 1, n))
    sql = spark.createDataFrame(docs, SCHEMA).withColumn("a.b", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(*sql).collect()} == want
    two = [(k, e, f) for k, (e, f) in enumerate(itertools.combinations(range(20), 2))]
    item = [f"w{j}" for j in range(20)]
    docs = [(k, " ".join("other" if j in (e, f) else w for j, w in enumerate(item))) for k, e, f in two]
    rule = [k for k, t in docs if brute.agrees(t.split(), item, 0, decontaminate.WINDOW, decontaminate.EQUAL)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count()
    assert got >= 0.99 * len(rule)


def test_lower_casing_is_of_ascii_alone(spark):
    text = "ÉCOLE a b c d e f g h i j k l m n ÉTÉ"
    docs, items = spark.createDataFrame([(1, text), (2, text.replace("É", "é").upper().replace("É", "é")), (3, text.lower())], SCHEMA), spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted((r.doc_id, r.length) for r in decontaminate.overlaps(docs, items).collect()) == [(1, 16), (2, 14), (3, 14)]


def test_words_are_not_shuffled_before_hits(spark, capsys):
    """What meets the seeds, and is made distinct, is (text, place, seed) and (text, item, diagonal)."""
    docs = spark.createDataFrame([(1, "a b")], SCHEMA)
    decontaminate._seeded(decontaminate._keyed(docs).select(*decontaminate.TEXT, decontaminate.alnum_words(F.col("text")).alias("words")), decontaminate.TEXT, "i", decontaminate.MASKS).join(
        spark.range(100).select(F.col("id").alias("seed"), F.col("id").alias("p")).hint("merge"), "seed"
    ).explain("formatted")
    exchanged = [line for line in capsys.readouterr().out.split("\n(") if " Exchange" in line.split("\n")[0]]
    assert exchanged and not any("words" in x or "hashes" in x for x in exchanged)


def test_decontamination_of_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(some, none).count() == 0 and decontaminate.without_overlaps(some, none).count() == 1
    assert decontaminate.overlaps(some.limit(0), some.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer(models.Unigram(token_counts.vocabulary("piece_bpe_32k"), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    return t


def test_token_counts_match_the_library(spark, exact):
    rng = random.Random(1)
    odd = ["", None, " ", "  a", "a  ", "\n", "日本語 テスト", "😀x", "<s>", "<0x41>", "▁", "▁a", "a▁b", "a" * 40, "x " * 3000] + ["".join(rng.choice("abe \n日é😀t") for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], SCHEMA))
    texts = dict(docs.collect())
    got = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("x"))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_tokens == len(exact.encode(texts[r.doc_id] or "").ids)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_ties_go_to_the_earliest_start():
    pieces = [("<unk>", -9.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -4.0)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(pieces)
    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> j & 1] for j in range(n))
            assert counter.text(word)[1] == len(t.encode(word).ids)
