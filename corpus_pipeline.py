"""From raw documents to sampled token sequences: the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from liftwise.llm.common import saved, table
from liftwise.llm.exact_dedup import drop_copies
from liftwise.llm.language_id import known_language
from liftwise.llm.mixing import mixed_documents
from liftwise.llm.pieces import sample_segmentations
from liftwise.llm.simhash import keep_one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language the model knows, go."""
    return known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every text stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near-duplicates stays, the one with the smallest id."""
    return keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents repeat where a target exceeds its source."""
    return mixed_documents(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document in the mix, with their pieces and scores."""
    return sample_segmentations(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mix_sources", source_mix),
    ("sample_pieces", sampled_pieces),
]

# The classifier and the sampled segmentations have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
