"""Queries of the training-data operators: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bitplanes, html, langid, media, mixing, packing, pii, quality, runs, separators, simhash, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_query(_documents(spark, sf_dir))


def op3_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_query(_documents(spark, sf_dir))


def op5_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op7_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.bitplane_query(_documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(_documents(spark, sf_dir))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(_documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(_documents(spark, sf_dir))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_query(_documents(spark, sf_dir))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_query(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media_sniffing": op2_media_sniffing,
    "op3_separators": op3_separators,
    "op4_pii": op4_pii,
    "op5_entropy_balance": op5_entropy_balance,
    "op6_packing": op6_packing,
    "op7_bitplanes": op7_bitplanes,
    "op8_quality_rules": op8_quality_rules,
    "op9_string_kernel": op9_string_kernel,
    "op10_simhash": op10_simhash,
    "op11_html": op11_html,
    "op12_alignment": op12_alignment,
    "op13_runs": op13_runs,
}

#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": quality.oracle_sql(),
}
