"""A pipeline over ``documents``: each stage's output is written as Parquet and
read again as the next one's input.

STAGES: (name, function) in order; a function takes (spark, docs, sf_dir) and
gives the documents that stay, with the columns of ``documents``.  The last one
adds mix_size, mix_target and mix_taken (words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm.common import stash
from sievewright.llm.decontaminate import drop_contaminated
from sievewright.llm.language_id import keep_languages
from sievewright.llm.line_dedup import drop_common_lines, with_kept_text
from sievewright.llm.mixing import mixed_documents
from sievewright.llm.near_dedup import drop_near_copies

#: A text goes whose words are told with less than this, in the mean of each
#: word's largest posterior: a text that switches languages is as sure as one
#: that does not.
MIN_LANGUAGE_SCORE = 0.4
#: Lines found in so many documents go.
COMMON_LINE_DOCS = 10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose language can't be told."""
    return keep_languages(docs, min_score=MIN_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines found in many documents out of the texts."""
    return with_kept_text(drop_common_lines(docs, min_docs=COMMON_LINE_DOCS, batches=4), "text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Language ID and near-duplicates are beyond SQL; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{i}-{name}")
    return docs
