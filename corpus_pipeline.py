"""The corpus pipeline: quality classifier, exact dedup, near dedup, mixing and packing, each over all its predecessor kept.

All columns of the input go through every stage but the last as they are, whatever their names; doc_id, text and source are read.
Defined results: a null text is an empty one. Rows with a null doc_id are scored and deduplicated like others; as near
duplicates they have no component and stay. Rows that repeat are copies: in exact dedup those of the largest doc_id stay, which
are several where that row itself repeats. An empty table, and one of which no document is good enough, gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import op3_quality, op5_packing, op6_minhash, op8_mixing, op9_exact_dedup
from stringloom.llm.common import given, renamed, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    model = op3_quality.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.where(op3_quality.scoring(docs, model) >= op3_quality.THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    rows, names = renamed(docs)
    return given(op9_exact_dedup.exact_dedup(rows).where("kept"), names)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id."""
    gone = stage(op6_minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "near-gone")
    rows, names = renamed(docs)
    return given(rows.join(gone, "doc_id", "left_anti"), names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix has it."""
    rows, names = renamed(docs)
    return given(op8_mixing.mix(rows), names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens."""
    return op5_packing.pack(docs.select("doc_id", F.col("text")))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier, the seeded sample or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
