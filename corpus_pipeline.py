"""From raw documents to packed training sequences, a stage at a time.

Each stage reads what its predecessor wrote. The first four return the columns of ``documents``; the last says where
each piece of each document that is left lies, with its token ids, so that the pieces of a bin in order are a training
sequence. The rules for nulls, ties, repeated rows and empty
tables are those of the operators that the stages call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from confluo.llm import pack_sos, quality_gam, secret_guess, simhash_gray, wu_manber
from confluo.llm.tokens import default_tokenizer
from confluo.session import ensure_checkpoint_dir, remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, doesn't reject."""
    return quality_gam.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_gray.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return wu_manber.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secret_guess.redact_secrets(docs, tokenizer=default_tokenizer(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each piece of each document, and where it lies in the training sequences."""
    return pack_sos.pack_documents(docs, tokenizer=default_tokenizer(spark))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: Neither the fitted classifier nor the order-dependent packing is a SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written as Parquet to the shared folder and read again.

    What a stage was given goes once the stage has been written. The last result stays, as it is what is returned.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
