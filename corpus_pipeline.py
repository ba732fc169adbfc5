"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing, each stage over all that the last one kept.

Between stages documents are written as Parquet in the shared scratch folder and read again, so a stage that loses an
executor starts from its predecessor's table, which goes when the stage is written.

Every stage takes documents with at least the columns of COLUMNS, whose order doesn't matter; others are left out, except by
packing, which doesn't look at them.  Empty tables give empty tables.  Null texts are kept by all filters, and packed as
empty.  Rows that repeat a document are judged alike by the classifier and the secret scan, are near duplicates of each
other (unless without words), and are otherwise mixed and packed as often as they occur.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard_join, mixing, packing, secrets, toxicity
from quern.storage import delete, owned, scratch_root, ship

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _tables(sf_dir: str):
    """A stage's scratch tables; they go when the next stage of a run over the same tables begins, as its input is written then."""
    return owned(f"pipeline {sf_dir}")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain doesn't reject; the chain learns from the labelled ones among them."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with _tables(sf_dir):
        chain = toxicity.train(docs, labels)
        return toxicity.classify(docs, chain).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; documents without words stay."""
    ship(spark)
    with _tables(sf_dir):
        return jaccard_join.one_of_each(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every confirmed secret replaced by a mark, and n_chars to match."""
    with _tables(sf_dir):
        redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source's words come near its target."""
    with _tables(sf_dir):
        return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences, with their ids."""
    ship(spark)
    with _tables(sf_dir):
        return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, a forest and tokenizers aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of ``sf_dir``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its ids are written, so it doesn't read the documents again
    delete(spark, before)
    return packed
