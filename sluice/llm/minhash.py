"""Near-duplicate documents by b-bit MinHash.

1.  Each text becomes the set of its word shingles (64-bit hashes), that set a signature of 128 minima, and the
    signature 32 band keys of 4 minima each plus the two low bits of every minimum, packed into four longs.
2.  Documents with equal sets form one class; only the smallest doc_id of each goes on.
3.  Members of a band bucket are paired with the bucket's smallest member: a star, never all pairs.
4.  A pair goes on if the collision-corrected estimate from the packed bits reaches `floor`; then the two full sets
    are compared.  A sieve of the wanted ids is broadcast first, so that other texts are not shuffled.
5.  Buckets that still hold more than one component are searched again in blocks, signatures against signatures and
    then sets of 32-bit hashes, for pairs across components only; what passes is compared in full.  So no link between
    candidates is lost, a bucket of linked copies costs as many comparisons as it has members, and what leaves a block
    is links, never pairs that are merely alike.

Defined results: a null text, or one without words, has an empty set, links with nothing and keeps its own id.
Repeated rows are returned as often as they come; a doc_id stands for one text, and which of several would be linked is
undefined.  A null doc_id joins its equal set's class, is kept only if that has no other id, and links with nothing
else.  Of equal candidates the smallest doc_id is the centre.  Very long texts are hashed a slice at a time, their sets
are compared two at a time.  Other columns, whatever their names, are ignored.  An empty table gives an empty result.

`representatives` does not rest on doc_id: each row is judged by its own text, under a number written for it, so null
and repeated doc_ids lose no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as tk
from sluice.llm.runtime import Scratch, columns, components, sifted

BANDS, ROWS_IN_BAND, BITS = 32, 4, 2
HASHES = BANDS * ROWS_IN_BAND
WORDS = HASHES * BITS // 64
#: Estimates below this are dropped.  At a similarity of 0.8 the estimate's standard deviation is 0.042.
FLOOR = 0.6
#: Members of a bucket, and bytes of their sets, that one task holds against as many others.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: The first bit of each packed value.
PAIRS_MASK = 0x5555555555555555

_SALT = (tk.stream(HASHES, 11) >> tk.U(32)).astype(np.uint32)
_ODD = (tk.stream(HASHES, 23) >> tk.U(32)).astype(np.uint32) | np.uint32(1)


def minima(members: np.ndarray) -> np.ndarray:
    """The signature of a set of 64-bit hashes."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    short = (members >> tk.U(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(low, ((short[None, at : at + 2048] ^ _SALT[:, None]) * _ODD[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(len(low), BANDS, ROWS_IN_BAND).astype(tk.U)
    acc = np.zeros(rows.shape[:2], tk.U)
    for r in range(ROWS_IN_BAND):
        acc = acc * tk.U(tk.MULTIPLIER) + rows[:, :, r]
    return tk.mix(acc + tk.stream(BANDS, 37))  # a key belongs to one band


def packed(low: np.ndarray) -> np.ndarray:
    values = (low & np.uint32(3)).astype(tk.U).reshape(len(low), WORDS, 32)
    return (values << (np.arange(32, dtype=tk.U) * tk.U(BITS))).sum(axis=2, dtype=tk.U)


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig array<long>"


def _signer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tk.slices(batches):
            low, sizes, keys = [], [], []
            for members in tk.shingle_sets(texts, shingle):
                sizes.append(len(members))
                keys.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                low.append(minima(members))
            low = np.array(low)
            bands, sigs = band_keys(low).view(np.int64), packed(low).view(np.int64)
            as_lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), as_lists(bands), as_lists(sigs)],
                ["doc_id", "n_shingles", "set_key", "bands", "sig"],
            )

    return run


def _verifier(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            texts_a = tk.Texts(batch.column("text_a"))
            ids_b, column_b = batch.column("b").to_pylist(), batch.column("text_b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                if ids_b[i] != last:
                    last, held = ids_b[i], next(tk.shingle_sets(tk.Texts(column_b.slice(i, 1)), shingle))
                own = next(tk.shingle_sets(tk.Texts(pa.array([texts_a.raw(i)], pa.large_binary())), shingle))
                both = len(np.intersect1d(own, held, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(own) + len(held) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def estimate(a: str, b: str):
    """Similarity from packed low bits: the agreeing share, less what agrees by chance."""
    differing = sum(
        (F.bit_count((x := F.element_at(a, w + 1).bitwiseXOR(F.element_at(b, w + 1))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(PAIRS_MASK))) for w in range(WORDS)),
        F.lit(0),
    )
    chance = 1 / (1 << BITS)
    return (1 - differing / HASHES - chance) / (1 - chance)


def _small_sets(shingle: int):
    """Sorted distinct 32-bit hashes of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in tk.slices(batches):
            sets = [np.unique((x >> tk.U(32)).astype("<u4")).tobytes() for x in tk.shingle_sets(texts, shingle)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "small"])

    return run


def _across(percent: int):
    """Likely links of one pair of a bucket's blocks: components differ, no earlier band holds both, estimate and 32-bit sets agree.

    Truncated hashes can only merge members, so a slack of one percent and two members keeps every true link.
    """
    most = int((1 - (FLOOR * 0.75 + 0.25)) * HASHES + 1e-9)

    def run(key, table):
        ids, side = table["doc_id"].to_numpy(), table["side"].to_numpy()
        component, center = table["component"].to_numpy(), table["center"].to_numpy()
        lists = lambda name, n: np.asarray(table[name].combine_chunks().flatten()).reshape(-1, n)
        sig, bands = lists("sig", WORDS).view(tk.U), lists("bands", BANDS)
        bands = bands[:, : int((bands[0] == key[0].as_py()).argmax())]
        sets = [np.frombuffer(x.as_py(), "<u4") for x in table["small"]]
        size = np.array([len(x) for x in sets])
        same = bool((side == 2).any())
        left, right = (np.flatnonzero(side == 2),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        out_a, out_b = [], []
        for i in left:
            other = right[(component[right] != component[i]) & (ids[right] != center[i]) & (ids[i] != center[i])]
            if same:
                other = other[ids[other] > ids[i]]
            other = other[100 * np.minimum(size[other], size[i]) + 200 >= (percent - 1) * np.maximum(size[other], size[i])]
            x = sig[other] ^ sig[i]
            other = other[np.bitwise_count((x | (x >> tk.U(1))) & tk.U(PAIRS_MASK)).sum(axis=1) <= most]
            for j in other[~(bands[other] == bands[i]).any(axis=1)]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * (both + 2) >= (percent - 1) * (size[i] + size[j] - both - 2):
                    out_a.append(max(ids[i], ids[j]))
                    out_b.append(min(ids[i], ids[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, set_id (smallest doc_id with an equal set)."""
    scratch = Scratch(docs.sparkSession)
    plain = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(plain.mapInArrow(_signer(shingle), SIGNATURE_SCHEMA))
    classes = scratch.keep(signed.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("copies")))
    first = scratch.keep(
        signed.filter("n_shingles > 0").select("doc_id", "n_shingles", "bands", "sig").join(classes.select(F.col("set_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    )
    banded = first.select("doc_id", F.explode("bands").alias("key"))
    centers = banded.groupBy("key").agg(F.min("doc_id").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = scratch.keep(banded.join(centers, "key").select("key", "doc_id", "center", "n"))
    sig = first.select("doc_id", "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        def texts(side: str) -> DataFrame:
            return sifted(plain.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side, pairs)

        return scratch.keep(pairs.join(texts("a"), "a").join(texts("b"), "b").mapInArrow(_verifier(shingle, percent), "a long, b long"))

    stars = member.filter("doc_id != center").select(F.col("doc_id").alias("a"), F.col("center").alias("b")).distinct()
    likely = (
        stars.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        .filter(estimate("sig_a", "sig_b") >= FLOOR)
        .select("a", "b")
    )
    likely = scratch.keep(likely)
    links = verified(likely)
    found = scratch.keep(components(links, scratch))

    # Buckets of three or more that hold several components: pairs across those, in blocks of bounded size.
    label = member.filter("n > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_buckets = label.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    opened = scratch.keep(label.join(open_buckets, "key").select("key", "doc_id", "center", "component"))
    sized = opened.join(first.select("doc_id", "n_shingles"), "doc_id").groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("held"))
    sized = sized.select("key", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("held") * 4 / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("doc_id", F.lit(5)), blocks).cast("int")
    # No semi join: Spark moves one below the sieve, and all texts are shuffled again.
    small = scratch.keep(opened.select("doc_id").distinct().join(sifted(plain, "doc_id", opened), "doc_id").mapInArrow(_small_sets(shingle), "doc_id long, small binary"))
    dealt = (
        opened.join(sized, "key")
        .join(first.select("doc_id", "sig", "bands"), "doc_id")
        .join(small, "doc_id")
        .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(
            "*",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    more = scratch.keep(dealt.groupBy("key", "i", "j").applyInArrow(_across(percent), "a long, b long").distinct())
    whole = found
    if not more.isEmpty():
        # The links found already stand as one link from each node to its component.
        late = verified(more)
        joined = found.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late)
        whole = scratch.keep(components(joined, scratch))
        scratch.drop(late, found)
    scratch.drop(likely, links, member, opened, small, first, more)
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(classes.select("set_key", "set_id"), "set_key", "left")
        .join(whole.select(F.col("node").alias("set_id"), "component"), "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "set_id", "doc_id").alias("component_id"),
            F.coalesce("component", "set_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
            F.coalesce("set_id", "doc_id").alias("set_id"),
        )
    )


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component of rows one.

    That is the one with the smallest doc_id, null behind all others, and of equal ids the one with the smallest hash
    of its text.  A row whose text has no words links with nothing and stays, but of equal rows (doc_id not null) one.
    """
    scratch = Scratch(docs.sparkSession)
    row = "_row"
    plain = columns(docs, "doc_id", "text")
    rows = scratch.numbered(plain, row)
    judged = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle, percent)
    judged = judged.select(F.col("doc_id").alias(row), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    ids = rows.select(row, "doc_id", F.xxhash64("text").alias("text_key"), F.when(F.col("doc_id").isNotNull() & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).alias("text"))
    wordless = F.col("component").isNull()
    # Texts without words: equal rows share a group, and a null doc_id has the row's own.
    group = [F.col("component"), *(F.when(wordless, x) for x in (F.col("doc_id"), F.col("text"), F.when(F.col("doc_id").isNull(), F.col(row))))]
    stays = judged.join(ids, row).groupBy(*[x.alias(f"g{i}") for i, x in enumerate(group)]).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", row)).alias("least"))
    return rows.join(stays.select(F.col(f"least.{row}").alias(row)), row, "left_semi").select(plain.columns).toDF(*docs.columns)
