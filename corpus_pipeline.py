"""From raw documents to packed sequences, as stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightmatch.llm import exact_dedup, langid, minhash, packing, quality, queries
from sightmatch.sources.scratch import fresh_path

#: A language's share of the decoding below which a text counts as of no known language.
LEAST_SHARE = 0.4


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, queries.trusted_ids(spark, sf_dir))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs), LEAST_SHARE)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.ENGLISH)


STAGES = [
    ("quality", good_text),
    ("language", known_language),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("packing", packed),
]

#: Models and tokenizers are beyond SQL; the tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
