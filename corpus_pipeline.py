"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but the last keep the columns of documents.
Between stages the rows are written as Parquet to the shared folder and read again, so a lost executor costs one stage
at most.

Defined cases of all stages: nulls in any column are kept as they are; a null text is clean, alone in its class, without
passages and personal data, and has the end id only; an empty text likewise; very long texts are worked on whole; rows
that repeat doc_id and text count once after the near-duplicate stage, if they have words or signs; rows of one doc_id
with other texts are documents of their own; an empty table stays empty; further columns, whatever their names, are kept
by all stages but the last. Of the documents of a class the one with the smallest doc_id stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, neardup, pieces, pii, toxicity
from keyloom.llm.common import read_table, shared_dir
from keyloom.sources.files import Files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model is learnt from the labelled rows of docs."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.without_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. A training corpus must hold no test passage, so one item
    is enough here; the query's flag asks for two."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"), min_items=1)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the text."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with the end id, decoded text."""
    done = pieces.encode_documents(docs, pieces.load(pieces.model_path()))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_pii),
    ("sentencepiece", tokenise),
]

#: No SQL states the learnt and hashed stages; tests/llm/test_pipeline.py compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    files = Files(spark, folder)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            files.delete(f"{k - 1}-{STAGES[k - 1][0]}")  # the stage after it is written
    return docs
