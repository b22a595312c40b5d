"""The queries of this subpackage and the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from confluo.llm import host_suffix, line_rules, pack_sos, quality_gam, secret_guess, simhash_gray, sstable, toxicity_ordinal, url_rules, wu_manber
from confluo.llm.tokens import default_tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good, by a model fitted to the labels."""
    return quality_gam.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies."""
    return simhash_gray.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document."""
    return wu_manber.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards of token ids, in file order."""
    return sstable.build_shards(_table(spark, sf_dir, "documents"), tokenizer=default_tokenizer(spark))


def op7_pack_sos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids in training sequences."""
    return pack_sos.pack_documents(_table(spark, sf_dir, "documents"), tokenizer=default_tokenizer(spark))


def op2_secret_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in a credential's place, with its guess cost."""
    return secret_guess.scan_secrets(_table(spark, sf_dir, "documents"), tokenizer=default_tokenizer(spark))


def op6_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity."""
    return toxicity_ordinal.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and exception that each page's URL matches."""
    return url_rules.filter_urls(_table(spark, sf_dir, "pages"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its bad lines went."""
    return line_rules.clean_lines(_table(spark, sf_dir, "documents"))


def op10_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without what repeats across its host."""
    return host_suffix.extract_pages(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_gam, op2_secret_guess, op3_wu_manber, op4_simhash_gray, op5_sstable, op6_toxicity_ordinal, op7_pack_sos, op8_url_rules, op9_line_rules, op10_host_suffix)}


def oracle_sql() -> dict[str, str]:
    return {"op3_wu_manber": wu_manber.ORACLE, "op8_url_rules": url_rules.oracle(), "op9_line_rules": line_rules.ORACLE}
