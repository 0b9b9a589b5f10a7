"""Sharding under one law: bytes (Karmarkar-Karp differencing), rows or key.

`bytes`: rows with equal text form a group that no shard splits.  A group starts as a partial partition that has its
bytes in one of the sets and nothing in the others.  Differencing takes the two partial partitions with the largest
spread, adds them oppositely ordered (largest set to smallest), and goes on until one is left.  Blocks of groups are
differenced on executors; the block results are partial partitions themselves, and are differenced again, a thousand
at a time, until one remains.  No step holds more than BLOCK groups, and the driver holds none.

`rows`: rows are dealt in turn, so counts differ by one at most.  `key`: the shard with the largest hash of (doc_id,
shard) takes the row, so one more shard takes rows only into itself; `grown_shard` says where they go then.

Defined results: null text has no bytes (size 8) and is the empty text's group; a group larger than its fair share
has a shard nearly to itself, and the others stay even; repeated rows are kept; between partial partitions of equal
spread the earlier is taken first; very long texts only weigh more; other columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.runtime import Scratch, columns, parts

BLOCK, FAN, SLOT_ROWS = 50_000, 1_000, 20_000
LAWS = ("bytes", "rows", "key")


def differenced(parts_: np.ndarray) -> np.ndarray:
    """For partial partitions (rows of k sums) the final set of each one's sets."""
    n, k = parts_.shape
    sums = list(parts_)
    spread = parts_.max(axis=1) - parts_.min(axis=1)
    heap = [(-int(s), i) for i, s in enumerate(spread)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # children, and the set of each that goes to set j
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        both = sums[a][down] + sums[b][up]
        sums[a] = sums[b] = None
        made.append((a, b, down, up))
        sums.append(both)
        heapq.heappush(heap, (-int(both.max() - both.min()), n + len(made) - 1))
    final: list = [None] * (n + len(made))
    final[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, down, up = made[i]
        top, final[n + i] = final[n + i], None
        for child, order in ((a, down), (b, up)):
            own = np.empty(k, np.int64)
            own[order] = top
            final[child] = own
    return np.array(final[:n])


def _block(shards: int):
    def run(key, groups):
        groups = groups.sort_by([("weight", "descending"), ("text_key", "ascending")])
        weight = groups["weight"].to_numpy()
        start = np.zeros((len(weight), shards), np.int64)
        start[:, 0] = weight
        return groups.select(["block", "text_key", "weight"]).append_column("bin", pa.array(differenced(start)[:, 0], pa.int64()))

    return run


def _merge(key, rows):
    rows = rows.sort_by("id")
    sums = np.array(rows["sums"].to_pylist(), np.int64)
    final = differenced(sums)
    total = np.zeros(sums.shape[1], np.int64)
    np.add.at(total, final.reshape(-1), sums.reshape(-1))
    return pa.table({"id": rows["id"], "up": pa.array([key[0].as_py()] * len(sums), pa.int64()), "final": pa.array(final.tolist(), pa.list_(pa.int64())), "total": pa.array([total.tolist()] * len(sums), pa.list_(pa.int64()))})


def _groups_to_shards(groups: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """groups(text_key, weight) -> text_key, shard."""
    groups = scratch.keep(groups)
    count = parts(groups.count(), BLOCK)
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("text_key"), F.lit(count)))
    placed = scratch.keep(dealt.groupBy("block").applyInArrow(_block(shards), "block long, text_key binary, weight long, bin long"))
    sums = placed.groupBy(F.col("block").alias("id")).agg(*[F.coalesce(F.sum(F.when(F.col("bin") == s, F.col("weight"))), F.lit(0)).alias(f"s{s}") for s in range(shards)])
    level = sums.select("id", F.array(*[f"s{s}" for s in range(shards)]).alias("sums"))
    out = placed.select("text_key", F.col("block").alias("id"), "bin")
    while True:
        merged = scratch.keep(level.groupBy((F.col("id") % parts(count, FAN)).alias("up")).applyInArrow(_merge, "id long, up long, final array<long>, total array<long>"))
        out = out.join(merged.select("id", "up", "final"), "id").select("text_key", F.col("up").alias("id"), F.element_at("final", (F.col("bin") + 1).cast("int")).alias("bin"))
        count = parts(count, FAN)
        if count == 1:
            return out.select("text_key", F.col("bin").alias("shard"))
        level = merged.groupBy(F.col("up").alias("id")).agg(F.first("total").alias("sums"))


def _keyed(shards: int) -> Column:
    ranked = F.array_max(F.array(*[F.struct(F.xxhash64("doc_id", F.lit(s)).alias("h"), F.lit(s).cast("long").alias("s")) for s in range(shards)]))
    return ranked["s"]


def shard(docs: DataFrame, shards: int = 24, law: str = "bytes") -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    if law == "bytes":
        rows = scratch.keep(rows)
        to = _groups_to_shards(rows.groupBy("text_key").agg(F.sum("size").alias("weight")), shards, scratch)
        rows = rows.join(to, "text_key")
    elif law == "key":
        rows = rows.withColumn("shard", _keyed(shards))
    rows = scratch.keep(rows.drop("text_key"))
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts(rows.count(), SLOT_ROWS)))
    if law == "rows":
        rows = rows.withColumn("shard", F.lit(0).cast("long"))
    numbered = rows.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")).cast("long") - 1)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.withColumn("part", part).groupBy("shard", "part").agg(F.count(F.lit(1)).alias("m")).select("shard", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    out = numbered.join(base, ["shard", "part"]).withColumn("slot", F.col("base") + F.col("n"))
    if law == "rows":
        out = out.withColumn("shard", F.col("slot") % shards).withColumn("slot", F.floor(F.col("slot") / shards))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", (_keyed(shards + 1) if law == "key" else F.lit(None)).cast("int").alias("grown_shard"))
