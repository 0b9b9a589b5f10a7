"""The training-data pipeline over `documents`: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  No ORACLE_SQL: Viterbi
decoding, MinHash and best fit can't be put in SQL, so tests/llm holds run() against a brute-force version.

Defined results, of every stage: a null in any column is carried on, null text counts as empty; repeated rows are judged
each, but near duplicates keep one of a group; very long texts are worked on whole; an empty table gives an empty result;
columns beyond those of documents, whatever their names, go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.decontaminate import without_overlaps
from sluice.llm.minhash import representatives
from sluice.llm.packing import pack
from sluice.llm.quality_rules import retained
from sluice.llm.repeats import remove_repeats
from sluice.llm.runtime import Scratch, columns

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """docs with the columns of documents alone."""
    return columns(docs, *COLUMNS).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or are mostly boilerplate lines, go."""
    return retained(_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays, once; rows with a null or shared doc_id are judged each by their own text."""
    return representatives(_documents(docs), shingle=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a smaller doc_id holds are cut from the text; no document goes."""
    found = remove_repeats(_documents(docs), length=50)
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, also those with a null doc_id; a clean row that shares a doc_id with one stays."""
    return without_overlaps(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences of 1024."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicate), ("suffix_repeats", repeats), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet and read again as the next one's documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
