"""The corpus pipeline: documents without toxic ones, near copies, repeated passages and personal data, packed into windows.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; the result is written as Parquet and read again for the next stage. All
stages but the last return the columns of the documents. Rows with a null text
or doc_id pass through the filters unharmed and end in no window if they have no
tokens; each operator's docstring states its other edge cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm._frame import materialise
from tidewater.llm.packing import pack_windows
from tidewater.llm.pii import redact_pii
from tidewater.llm.simhash import drop_near_copies
from tidewater.llm.substring import drop_repeats
from tidewater.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on ``labels``, doesn't reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies."""
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of passages of 50 tokens and more."""
    return drop_repeats(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-equal windows of at most 4096 tokens."""
    return pack_windows(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("pii", private_data),
    ("packing", packing),
]

#: SQL can express neither a trained model nor random recursion; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
