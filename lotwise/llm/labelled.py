"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: At most so many labelled rows are used to fit a classifier (16 bytes each when broadcast).
MAX_LABELLED = 50_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train: Column, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, label: at most ``limit`` labelled training documents, those with the smallest id hash.

    Null labels and ids are left out; of labels that repeat an id the largest counts; documents that repeat
    id and text count once, so that a repeated id takes no more of the sample than its different texts.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & train)
    # The condition leaves a tenth more than ``limit``, so that the sort isn't over all labels.
    known = known.filter(shared.smallest_hashes(["doc_id"], limit + limit // 10, known.count()))
    chosen = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = F.broadcast(chosen)  # bounded by ``limit``
    named = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    keys = named.select("doc_id", "text_hash").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(limit)
    return named.join(F.broadcast(keys), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text", "label")
