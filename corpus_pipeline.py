"""Corpus cleaning pipeline: each stage's result is written as Parquet and read again for the next.

1. toxicity       documents scored as toxic go
2. exact dedup    one document of each group of equal texts stays
3. n-gram Jaccard one document of each group of near duplicates stays
4. secret scans   secrets are masked in the text; every document stays
5. packing        what is left becomes training windows

A stage works on all that its predecessor kept. Null and empty texts, repeated rows and empty tables
pass through as each operator defines; extra columns of the documents are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lotwise.llm import exact_dedup, near_dup, packing, secrets, shared, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit_on(spark, sf_dir, docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.corpus_samples(docs)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_windows),
]

#: No SQL expresses training, MinHash verification or tokenisation; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = shared.documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if done is not None:  # only the next stage reads a stage's table
            shared.discard(done)
        done = docs
    return docs
