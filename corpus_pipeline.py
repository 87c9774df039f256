"""A training corpus from raw documents: quality, language, near-duplicates, mixing, packing.

Defined cases: null and empty texts hold no letter and go with the language stage, if the quality stage has kept them; very
long texts go through every stage whole; rows repeated whole, and rows without an id, are documents of their own until the
near-duplicate stage, which leaves one row of each group; a null source is a source of its own; ties are decided as each
stage states; empty tables give no rows; columns beyond those of documents are carried up to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import langid, mixing, packing, quality, simhash
from lexspark.llm.common import remove_folder, shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # three fingerprints of a text's different words find nearly all near copies; the texts then decide, by shingles of
    # five words, so that documents which only sound alike all stay
    return simhash.keep_one(docs, shingle=1, max_bits=5, min_similarity=0.8, distinct=True, count=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("language ID", known_languages),
    ("SimHash near-dedup", without_near_duplicates),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: Trained models, suffix automata, components and tokens are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; what each stage returns is written to the shared folder and read again.

    A stage's rows are deleted when the next one's are written. Those that the result is computed from stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
