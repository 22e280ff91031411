"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mixing, SentencePiece.

Each stage is written as Parquet and read again before the next, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skimdex.llm import line_dedup, mixing, quality, sentencepiece_codec, simhash
from skimdex.llm.common import shared_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines go, and of single lines of over 50 words; a document that loses every line goes."""
    return line_dedup.deduped_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budget of their domain, language and source says, twice at most."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of each row."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.model_path())


STAGES = [("quality", quality_rules), ("line_dedup", line_runs), ("near_dedup", near_duplicates), ("mix", source_mix), ("sentencepiece", token_ids)]

#: Fingerprints and piece scores are beyond SQL. The tests hold the counts of quality, line dedup, near-dedup and the best
#: splits against brute force; of the mix only a small budget, and of the whole pipeline columns and row counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
