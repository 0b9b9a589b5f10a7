import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import sharding

SCHEMA = "doc_id long, text string"


def rows():
    rng = random.Random(3)
    out = [(i, "x" * int(rng.paretovariate(0.8) * 20 % 5000)) for i in range(900)] + [(1000 + i, "the same text") for i in range(300)]
    return out + [(2000, None), (2001, ""), (None, "no id"), (1000, "the same text")]


@pytest.mark.parametrize("law,block,fan", [("bytes", 50_000, 1000), ("bytes", 60, 3), ("rows", 1, 2), ("key", 1, 2)])
def test_laws(spark, monkeypatch, law, block, fan):
    for name, value in (("BLOCK", block), ("FAN", fan), ("SLOT_ROWS", 100)):
        monkeypatch.setattr(sharding, name, value)
    data = rows()
    got = sharding.shard(spark.createDataFrame(data, SCHEMA), 6, law).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in data)
    shards = [[r for r in got if r.shard == s] for s in range(6)]
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards)
    if law == "bytes":
        assert len({(r.text_crc32, r.shard) for r in got}) == len({r.text_crc32 for r in got})
        sums = [sum(r.size for r in own) for own in shards]
        assert max(sums) - min(sums) <= (16 if block > 60 else 5000)
    if law == "rows":
        assert max(map(len, shards)) - min(map(len, shards)) <= 1
    if law == "key":
        assert all(r.grown_shard in (r.shard, 6) for r in got) and 0 < sum(r.grown_shard == 6 for r in got) < len(got) / 3
        assert {r.doc_id: r.shard for r in got} == {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(data[::-1], SCHEMA), 6, law).collect()}


def test_differencing_beats_greedy():
    rng = np.random.default_rng(0)
    weight = rng.integers(1, 10_000, 400)
    start = np.zeros((400, 8), np.int64)
    start[:, 0] = weight
    sums = np.bincount(sharding.differenced(start)[:, 0], weight, 8)
    greedy = np.zeros(8)
    for w in sorted(weight, reverse=True):
        greedy[greedy.argmin()] += w
    assert sums.sum() == weight.sum() and sums.max() - sums.min() <= greedy.max() - greedy.min()


def test_empty_table_and_bad_law(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert all(sharding.shard(empty, 4, law).count() == 0 for law in sharding.LAWS)
    with pytest.raises(ValueError):
        sharding.shard(empty, 4, "moon")


def plainly_differenced(weights, k):
    """Karmarkar-Karp on lists of items: the sums of the sets, largest spread first, earlier partition first among equals."""
    parts = [(max(w, 0), i, [[w] if j == 0 else [] for j in range(k)]) for i, w in enumerate(weights)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, a), (_, _, b), *parts = parts
        down, up = sorted(a, key=lambda s: -sum(s)), sorted(b, key=sum)
        both = [x + y for x, y in zip(down, up, strict=True)]
        sums = [sum(s) for s in both]
        parts.append((max(sums) - min(sums), made, both))
        made += 1
    return sorted(sum(s) for s in parts[0][2])


@pytest.mark.parametrize("seed", range(6))
def test_differencing_matches_a_plain_version(seed):
    rng = np.random.default_rng(seed)
    weight, k = rng.integers(1, (10, 1000, 10**12)[seed % 3], 120), 2 + seed
    start = np.zeros((len(weight), k), np.int64)
    start[:, 0] = weight
    sums = np.zeros(k, np.int64)
    np.add.at(sums, sharding.differenced(start)[:, 0], weight)
    assert sorted(sums.tolist()) == plainly_differenced(weight.tolist(), k)


def test_one_block_is_the_plain_version(spark):
    """Through shard(): groups are equal texts, and the shards' bytes are those of plain differencing over the groups."""
    data = [(i, t) for i, t in rows() if i is not None]
    groups = {}
    for _, t in data:
        groups[t or ""] = groups.get(t or "", 0) + len(t or "") + 8
    got = sharding.shard(spark.createDataFrame(data, SCHEMA).withColumn("Text.x", F.lit(1)).withColumn("SHARD", F.lit(2)), 6, "bytes").groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert sorted(r.s for r in got) == plainly_differenced(sorted(groups.values(), reverse=True), 6)
