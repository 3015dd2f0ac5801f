"""A training-data pipeline in five stages over ``documents``.

Toxic documents go, then exact copies, then near copies (five-word shingles, similarity of 0.8 or
more); the sources of what is left are mixed to target weights, and the mix is encoded and decoded again. Each stage
reads what the one before wrote. An empty table passes through every stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framequarry.llm import bpe, exact, mixing, near, toxicity
from framequarry.llm.base import fold
from framequarry.llm.queries import WEIGHTS, tokenizer_json
from framequarry.session import ensure_checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of any toxic grade is low; the model learns from the labels of ``sf_dir``."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents.filter(fold("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, null as empty, the row with the largest id."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group; documents without words or id stay."""
    return near.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so up to three times or not at all; a null source is one of its own."""
    return mixing.take(docs, WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``ids``, ``n_tokens`` and ``decoded_sha256``, the digest of the decoded ids, of each row; a null text has no ids."""
    out = bpe.round_trip(docs, tokenizer_json(), keep=["source"], with_ids=True)
    return out.select("doc_id", "source", "ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The toxicity model and the tokenizer can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is a table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
