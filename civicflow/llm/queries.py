"""Thin queries over whole tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from civicflow.llm import cap_filters, decontam, gray_simhash, license_scan, packing, pii, prefix_trie, quality, sharding, shallot, substrings, token_blocks, toxicity
from civicflow.llm.common import documents
from civicflow.session import table

SQL: dict[str, str] = {}


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


SQL["op1_spaced_seed_decontamination"] = decontam.SQL


def op2_spherical_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op2_spherical_cap_dedup"] = cap_filters.SQL


def op3_offset_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarise(pii.detect(documents(spark, sf_dir).select("doc_id", "text")))


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), with_ids=False)


def op5_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), with_text=False)


SQL["op5_debruijn_substrings"] = substrings.SQL


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_simhash.group_documents(documents(spark, sf_dir)).select(
        "doc_id", gray_simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.read_token_files(spark, token_blocks.write_token_files(documents(spark, sf_dir)))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs, quality.rated(table(spark, sf_dir, "labels")))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "expected_grade", "tail_probability", "tails", quality.keep().alias("kept"))


def op11_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


SQL["op11_license_signatures"] = license_scan.SQL


def op12_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.summary(*shallot.cluster_vectors(table(spark, sf_dir, "embeddings")))


SQL["op12_shallot_clusters"] = shallot.SQL


def op13_burst_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


SQL["op13_burst_prefix_trie"] = prefix_trie.SQL


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_spaced_seed_decontamination, op2_spherical_cap_dedup, op3_offset_preserving_pii, op4_power_of_two_packing, op5_debruijn_substrings, op6_lpt_sharding, op7_gray_simhash, op8_ftrl_toxicity, op9_pfor_token_files, op10_ordinal_quality,
                              op11_license_signatures, op12_shallot_clusters, op13_burst_prefix_trie)
}
