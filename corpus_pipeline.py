"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that the one before it left and returns a DataFrame, which is
written as Parquet in the shared folder and read again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetloom.llm import languages, mixing, ngram_join, packing, pseudonyms
from facetloom.llm.queries import tokenizer_path
from facetloom.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without a known language: no text, no letter, or no n-gram of a learned one."""
    return languages.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates."""
    return ngram_join.one_of_each_class(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format."""
    return pseudonyms.without_personal_data(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat the documents of smaller sources; none is left out."""
    return mixing.mixed_rows(docs, tokenizer_path=tokenizer_path())


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents, with their ids; a document that the mix repeats is packed each time."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

#: Pseudonyms and token ids have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        path = f"{folder}/{number}-{name}"
        done.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
