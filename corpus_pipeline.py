"""A training corpus from raw documents, in five stages that each take all their predecessor kept.

run() writes every stage to the folder that the cluster shares and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streetloom.llm import mixing, near_join, packing, privacy, quality_rules, runtime
from streetloom.llm.registry import vocabulary

#: No SQL: the packing of byte-pair encoded tokens has none. Tests hold it against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return near_join.one_of_each(docs, words=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it leave the texts."""
    return privacy.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document may come twice."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row per piece, with its ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.stage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
