"""A training corpus in five stages over the table documents.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the docs of the next.
All but the last return the columns of documents.

1. toxicity: documents with a noisy-or score of 0.5 or more go; the model learns from `labels`.
2. near_dedup: of documents that SimHash links join, the one with the smallest doc_id stays (null ids last, then the smallest hash of the text).
3. decontamination: documents that hold a ten-word window of `benchmark` go.
4. secrets: found secrets are masked in the text, and n_chars follows; no document goes.
5. packing: pieces of the documents take their places in sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, packing, secrets, simhash, toxicity
from lodestone.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack)]

#: A trained model, Arrow lexing and a tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
