"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.simhash import simhash_components

    return simhash_components(_read(spark, sf_dir, "documents"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents")).drop("places")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.line_dedup import find_duplicate_lines

    return find_duplicate_lines(_read(spark, sf_dir, "documents"), exact_chars=1).drop("text_key")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.toxicity import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.embeddings import link_embeddings

    return link_embeddings(_read(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.language_id import predict_languages

    return predict_languages(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.decontamination import find_contamination

    return find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_key")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.url_filters import judge_urls

    return judge_urls(_read(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.collocations import mine_collocations

    return mine_collocations(_read(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.quality_classifier import score_quality

    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.llm.hard_negatives import mine_hard_negatives

    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label"
    return mine_hard_negatives(_read(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", label))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_embeddings": op5_embeddings,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_collocations": op11_collocations,
    "op12_quality": op12_quality,
    "op13_hard_negatives": op13_hard_negatives,
}
