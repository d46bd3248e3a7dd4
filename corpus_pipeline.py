"""A corpus pipeline over the operators of graphloom.llm.

Stages, each on what its predecessor kept: toxic documents go; one document of each group
of near copies stays (five-word shingles, similarity 0.8); passages of 50 words or more
that an earlier document has are cut; documents that hold a benchmark item go; the rest
is packed along a space-filling curve. All stages but the last return the columns of
``documents``.

Edge cases: null or empty texts pass every stage unchanged (their ``n_chars`` too) and are
packed as the end id alone; rows with a null doc_id take part like others; of repeated rows
the second stage keeps one; empty tables give an empty result; extra columns are carried
to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import curve, decon, knn, rlz, superminhash, tokens
from graphloom.llm.store import discard, shared_dir, table

PASSAGE_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return knn.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return superminhash.first_of_each(docs, 5, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = rlz.cleaned(docs, PASSAGE_WORDS)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decon.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curve.pack_with_crc(docs, tokens.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage's learned or approximate decisions can be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/graphloom-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            discard(docs)
        docs = spark.read.parquet(path)
    return docs
