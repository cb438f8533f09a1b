"""The queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, divergence, fingerprint, jaccard, license_scan, merkle, mixing, pii, quality, substring_dedup, suffix_dedup, token_io, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(_documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(_documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_documents(spark, sf_dir))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_substring_dedup, op4_quality_classifier, op5_mixing, op6_license_scan, op7_decontamination, op8_ngram_jaccard_join, op9_token_ids, op10_fingerprints, op11_merkle_manifest, op12_url_filters, op13_source_divergence)}
ORACLES = {"op1_pii": pii.oracle(), "op3_substring_dedup": substring_dedup.ORACLE, "op5_mixing": mixing.ORACLE, "op8_ngram_jaccard_join": jaccard.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_url_filters": url_filter.oracle(), "op13_source_divergence": divergence.ORACLE}
