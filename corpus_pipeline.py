"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tellurion.llm import language, mixing, packing, simhash, toxicity
from tellurion.llm.common import shared_folder, table
from tellurion.llm.queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more as toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, without text or a letter, go."""
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest doc_id."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Workers remember fewer words than they would for this alone."""
    return packing.pack(docs, tokenizer_path(), remember=150_000)


STAGES = [
    ("toxicity", clean),
    ("language", in_a_language),
    ("near duplicates", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages learn from labels, hash and iterate, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.

    The stages' tables go to a folder of their own in the session's checkpoint folder; the last is read again from there.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
