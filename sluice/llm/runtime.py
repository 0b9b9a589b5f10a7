"""What the operators of this folder share about the Spark session."""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, that Spark hands to Python at once; texts can be long, so far fewer than Spark's defaults.
ARROW_ROWS, ARROW_BYTES = 1000, "8m"
#: Longs, of 64 bits each, that sifted() sends to the executors at most.
SIEVE = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir, or a fresh one where it is unset and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sluice-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that one Arrow batch carries, so that a worker holds few texts at a time.

    Spark reads these settings when a result is executed, which is after an operator has returned, so they stay as they
    are set here; a session that already asks for fewer rows is left alone.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def _delete(jvm, conf, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    Results read them when they are executed, so they are deleted when the driver's process ends; drop() deletes sooner.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}"
        self.count = 0
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self._close)
        small_batches(spark)

    def _close(self) -> None:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone
            _delete(self._jvm, self._conf, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sluice_path = path
        return out

    def numbered(self, df: DataFrame, name: str) -> DataFrame:
        """df with a number for each row, written so that every reading of it sees the same numbers."""
        return self.keep(df.withColumn(name, F.monotonically_increasing_id()))

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that keep() wrote and that nothing reads any more."""
        for table in tables:
            _delete(self._jvm, self._conf, table._sluice_path)


def columns(table: DataFrame, *names: str) -> DataFrame:
    """table with all but these columns named by position: no other name, dotted, repeated or alike but for case, can clash.

    A column is found by its exact name, or else without case, as Spark finds it.
    """
    plain = [c.lower() for c in table.columns]
    at = {(table.columns.index(name) if name in table.columns else plain.index(name)): name for name in names}
    return table.toDF(*(at.get(i, f"_{i}") for i in range(len(table.columns))))


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def sifted(table: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Rows of table whose `name` is in wanted's column of that name, and few others: a join by it then shuffles few rows in vain.

    Each wanted value sets a bit of a filter that is broadcast; its size is bounded, so many values only let more rows pass.
    """
    key = F.xxhash64(name)
    slot = F.pmod(key, F.lit(SIEVE)).alias("_slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 58).cast("int"))
    sieve = wanted.select(slot, bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    return table.select("*", slot).join(F.broadcast(sieve), "_slot").filter(F.col("_bits").bitwiseAND(bit) != 0).select(table.columns)


def parts(size: int, each: int, least: int = 1) -> int:
    """So many parts of about `each`."""
    return max(least, math.ceil(size / each))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a long, b long): (node, component), component being the smallest node.

    Large-star and small-star steps, each a grouped minimum that is joined back, until nothing changes.  A hub of a
    million links is a million rows of a join that Spark can split, never a list.
    """
    pairs = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u != v")
            .distinct()
        )
        after = scratch.keep(small)
        mark = after.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        scratch.drop(pairs)
        pairs = after
        if mark == seen:
            break
        seen = mark
    return pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
