"""The corpus pipeline: documents that pass the quality classifier, once each, mixed and encoded."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import commentmill
from commentmill.functions.cut import ensure_checkpoint_dir
from commentmill.llm import bloom_dedup, mix_budget, quality_rff, tensor_minhash, wfst_pieces
from commentmill.llm.queries import GOOD, MIX, domain_of, table

cloudpickle.register_pickle_by_value(commentmill)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_rff.keep_good(docs, table(spark, sf_dir, "labels"), GOOD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return bloom_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8."""
    return tensor_minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights; a document of a source that is short may stand twice."""
    return mix_budget.mix_sources(docs, domain_of(), MIX).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each chosen document."""
    coded = wfst_pieces.encode(docs, wfst_pieces.load_vocabulary(), carry=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("encode", encode)]

#: SQL cannot fit the classifier; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is written in the shared folder and read again, so a lost
    executor never repeats an earlier stage. The folder, a new one for each run, stays there: who
    reads the result decides when it may go."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
