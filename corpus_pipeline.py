"""A document table made ready for training: five stages, each written as Parquet and read again as the next one's input.

1. Kneser-Ney quality classifier: rejected documents go.
2. Exact deduplication: of equal texts the smallest doc_id stays.
3. N-gram Jaccard join at five words and 0.8: one document of each component stays.
4. Personal data: entities and disclosing terms are replaced in the text.
5. Packing: length buckets and token-budget batches of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import exact_dedup, kneser_ney, length_buckets, ngram_join, pii
from cotejo.llm.common import read_table, remove_folder, shared_dir


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.keep_fluent(docs, read_table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_equal_texts(docs)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return length_buckets.pack_by_length(docs)


STAGES = [("quality classifier", classify), ("exact dedup", deduplicate), ("n-gram join", join_near), ("personal data", sanitise), ("packing", pack)]

#: A trained model and components of similar texts have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, which stay in the shared folder; a stage's table goes when the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/cotejo/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
