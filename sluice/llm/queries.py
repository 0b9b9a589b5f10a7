"""One thin query for each operator of this folder: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=1024)


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.repeats import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=50, with_text=False).drop("kept_text")


def op7_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.gam import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=24, law="bytes")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_minhash": op1_minhash, "op2_token_counts": op2_token_counts, "op3_best_fit_packing": op3_best_fit_packing, "op4_spaced_seeds": op4_spaced_seeds, "op5_license_diagonals": op5_license_diagonals, "op6_suffix_repeats": op6_suffix_repeats, "op7_additive_model": op7_additive_model, "op8_site_style_tree": op8_site_style_tree, "op9_sharding": op9_sharding, "op10_quality_rules": op10_quality_rules}
