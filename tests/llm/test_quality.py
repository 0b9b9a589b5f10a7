import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm import gam, quality_rules
from sluice.llm import textkit as tk
from tests.llm import brute

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_counts_and_base_rule(spark):
    docs, labels = tables(spark)
    odd = [(-1, None), (-2, ""), (-3, "\n \n"), (-4, "a\r\na\r\na"), (-5, "é日# x\n\nx\nx "), (-6, "w " * 5000), (-7, "one two three four five six seven eight " * 2 + "nine"), (-1, None)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, SCHEMA))
    texts = dict(both.collect())
    got = quality_rules.judge(both.withColumn("kept", F.lit(0)), labels).collect()
    assert len(got) == docs.count() + len(odd)
    for r in got:
        assert tuple(r[c] for c in COUNTS) == brute.quality_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_held_back_labels_agree(spark):
    docs, labels = tables(spark)
    train, test = labels.filter("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    got = [(r.kept, test[r.doc_id]) for r in quality_rules.judge(docs, train).collect() if r.doc_id in test and not r.base_failed]
    assert sum(k for k, q in got if q == 1) >= 0.98 * sum(q == 1 for _, q in got)
    assert sum(k for k, q in got if q == 0) <= 0.2 * sum(q == 0 for _, q in got)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(2)
    field = quality_rules.Field(rng.normal(size=(quality_rules.N_FLAGS, 2)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        flags = rng.integers(0, 2, (n, quality_rules.N_FLAGS)).astype(float)
        score = flags @ field.emission
        value = lambda s: sum(score[i, x] for i, x in enumerate(s)) + sum(field.transition[a, b] for a, b in itertools.pairwise(s))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert value(tuple(field.decode(flags, np.array([0, n])))) == value(best)


def test_lines_have_labels_of_their_own(spark):
    """Plain sentences and junk lines of one text are told apart, whatever its document's kind; the verdict follows from the share."""
    docs, labels = tables(spark)
    field = quality_rules.fit_field(docs, labels)
    plain = "The anes ly erer thtibleti annd, therheth ates of inheth a edti and onwh there ther onnte."
    junk = "THE!! AND!! EN!! ANDTH!! ERON!! OUHE!! THHEIN!!"
    for lines, want in (([plain, plain + " x", plain + " y", junk, junk + " EA!!"], [1, 1, 1, 0, 0]), ([junk, junk + " A!!", junk + " B!!", plain, plain + " z"], [0, 0, 0, 1, 1])):
        p = quality_rules.profile(tk.Texts(pa.array(["\n".join(lines)])))
        assert field.decode(quality_rules.line_flags(p), np.array([0, 5])).tolist() == want
    shares = [r.content_share for r in quality_rules.judge(docs, labels).filter("not base_failed").collect()]
    assert sum(0 < s < 1 for s in shares) > 0.05 * len(shares)


def test_verdict_against_plain_viterbi(spark):
    docs, labels = tables(spark)
    field = quality_rules.fit_field(docs, labels)
    texts = {r.doc_id: r.text for r in docs.filter("length(text) < 1500").collect()}
    got = {r.doc_id: r for r in quality_rules.judge(docs.filter("length(text) < 1500"), labels).collect()}
    field_of_part = quality_rules.fit_field(docs.filter("length(text) < 1500"), labels)
    assert field_of_part.emission.shape == field.emission.shape
    for i, text in texts.items():
        lines = [x for x in text.split("\n") if brute.SPACE.search(x)]
        if not 0 < len(lines) <= 9:
            continue
        flags = quality_rules.line_flags(quality_rules.profile(tk.Texts(pa.array([text]))))
        score = flags @ field_of_part.emission
        value = lambda s: sum(score[k, x] for k, x in enumerate(s)) + sum(field_of_part.transition[a, b] for a, b in itertools.pairwise(s))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(lines)), key=value)
        size = [len(x.encode()) for x in lines]
        share = sum(n for n, x in zip(size, best, strict=True) if x) / sum(size)
        assert abs(got[i].content_share - share) < 1e-9 and got[i].kept == (not got[i].base_failed and share >= quality_rules.CONTENT_SHARE)


def test_labels_agree_with_the_document():
    rng = np.random.default_rng(5)
    length, quality = rng.integers(1, 9, 40), rng.integers(0, 2, 40)
    lines = quality_rules.Sequences(length, np.ones(40))
    margin, size = rng.normal(size=length.sum()), rng.integers(1, 50, length.sum()).astype(float)
    label = quality_rules.agreeing(margin, size, lines, quality, 0.3)
    for d in range(40):
        own = slice(lines.first[d], lines.first[d + 1])
        free = (margin[own] >= 0).astype(int)
        share = lambda x: (size[own] * x).sum() / size[own].sum()  # noqa: B023, E731
        assert (share(label[own]) >= 0.3) == bool(quality[d])
        assert (share(free) >= 0.3) != bool(quality[d]) or (free == label[own]).all()


def thue_morse(n):
    line = "a"
    while len(line) < n:
        line += line.translate(str.maketrans("ab", "ba"))
    return line, line.translate(str.maketrans("ab", "ba"))


def test_lines_and_words_that_collide_modulo_powers_of_two(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for n in (64, 1024, 4096):
        a, b = thue_morse(n)
        docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{a}"), (3, " ".join([a, b] * 8))], SCHEMA)
        got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
        assert [got[i].n_dup_lines for i in (1, 2)] == [0, 1] and got[3].n_repeat_words == 16
        assert len(set(tk.word_hashes(tk.Texts(pa.array([a, b])))[0].tolist())) == 2


def test_string_hashes_follow_the_bytes_alone():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abé日"), rng.integers(1, 90))) for _ in range(3000)]
    one = tk.word_hashes(tk.Texts(pa.array([" ".join(words)])))[0]
    each = np.concatenate([tk.word_hashes(tk.Texts(pa.array([f"xx {w}"])))[0][1:] for w in words])
    assert (one == each).all() and len(set(one.tolist())) == len(set(words))


def test_shared_doc_ids_and_clashing_columns(spark):
    docs, labels = tables(spark)
    twice = docs.unionByName(docs).withColumn("sizes", F.lit("s")).withColumn("X", F.lit(1)).withColumn("a.b", F.lit(2))
    both = labels.unionByName(labels).withColumn("flags", F.lit("f"))
    assert np.allclose(quality_rules.fit_field(docs, labels).emission, quality_rules.fit_field(twice, both).emission)
    assert quality_rules.retained(twice, both).columns == twice.columns
    assert gam.classify(twice, both).count() == twice.count()


def test_retained_keeps_all_columns(spark):
    docs, labels = tables(spark)
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    out = quality_rules.retained(docs.withColumn("extra", F.lit("e")), labels)
    assert out.columns == [*docs.columns, "extra"] and {r.doc_id for r in out.collect()} == kept


def test_no_labels_and_empty_tables(spark):
    docs, labels = tables(spark)
    assert quality_rules.judge(docs.limit(5), labels.filter("false")).filter("content_share not in (0.0, 1.0)").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(empty, labels).count() == 0 and gam.classify(empty, labels).count() == 0
    scores = {r.score for r in gam.classify(docs.limit(5), labels.filter("false")).collect()}
    assert scores == {0.5}
    assert len({r.score for r in gam.classify(docs.limit(5), labels.filter("quality = 1")).collect()}) == 1


def test_additive_model_on_held_out_rows(spark):
    docs, labels = tables(spark)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 100_000), (-1, None), (None, "null id")], SCHEMA)
    got = gam.classify(docs.select("doc_id", "text").unionByName(odd).withColumn("quality", F.lit(9)), labels.withColumn("text", F.lit("t"))).collect()
    assert len(got) == docs.count() + 5
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    own = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum((s >= 0.5) == q for s, q in own) >= 0.95 * len(own)


def test_held_out_labels_are_never_read(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("quality", F.when(gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda table: [(r.doc_id, r.score) for r in gam.classify(docs, table).orderBy("doc_id").collect()]
    assert score(labels) == score(flipped)


def test_scores_are_sums_of_looked_up_values(spark):
    """The vectorised score against the model read value by value, and each tree against a plain search for its cut."""
    docs, labels = tables(spark)
    model = gam.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    sample = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["", "x" * 5000]
    x = gam.features(tk.Texts(pa.array(sample)))
    bin_of = lambda edges, v: sum(1 for e in edges if e <= v)
    for row, score in zip(x.tolist(), model.score(x), strict=True):
        total = model.base + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[bin_of(model.coarse[i], row[i])][bin_of(model.coarse[j], row[j])] for i, j, t in model.pairs)
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def test_two_way_tree_is_the_best_cut():
    rng = np.random.default_rng(2)
    g, w = rng.normal(size=(5, 4)), rng.random((5, 4)) * 9
    best = (-1.0, None)
    for r in range(1, 5):
        for c in range(1, 4):
            leaves = [(g[a, b].sum(), w[a, b].sum() + 3.0, (a, b)) for a in (slice(0, r), slice(r, 5)) for b in (slice(0, c), slice(c, 4))]
            gain = sum(s * s / n for s, n, _ in leaves)
            if gain > best[0] + 1e-12:
                best = (gain, leaves)
    want = np.zeros_like(g)
    for s, n, spot in best[1]:
        want[spot] = s / n
    assert np.allclose(gam._two_way(g, w), want)
