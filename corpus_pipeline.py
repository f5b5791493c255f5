"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. ``run`` writes every stage's result as
Parquet to the folder that the cluster shares and hands the next stage what it reads back. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm._shared import materialize
from parley.llm.decontamination import keep_uncontaminated
from parley.llm.language_id import keep_identified
from parley.llm.line_dedup import drop_duplicate_lines
from parley.llm.packing import pack_documents
from parley.llm.simhash import keep_one_of_each


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat a line kept elsewhere; ``n_chars`` follows the text."""
    return drop_duplicate_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SimHash, best-fit packing and rank-order profiles have no SQL form; tests compare the run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
