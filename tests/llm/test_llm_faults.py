"""Cases that once went wrong: repeated deliveries, repeated ids, null ids, extreme vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import embedding_dup, exact_dedup, labelled, near_dup, registry, shared


def test_a_batch_delivered_twice_is_kept_once(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    batch = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (None, "d")], "doc_id long, text string")
    first = exact_dedup.exact_dedup(batch, index).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.kept) for r in first if r.kept) == [(False, 1, True), (False, 3, True), (True, None, True)]
    again = exact_dedup.exact_dedup(batch, index).collect()
    assert len(again) == 4 and not any(r.kept for r in again) and {r.keep_id for r in again} == {1, 3, None}
    mixed = exact_dedup.exact_dedup(batch.unionByName(spark.createDataFrame([(9, "new"), (3, "c")], "doc_id long, text string")), index)
    assert [r.doc_id for r in mixed.collect() if r.kept] == [9]
    index.drop()


@pytest.mark.parametrize("stage", [exact_dedup.keep_first_copies, near_dup.keep_one_of_each])
def test_a_row_repeated_often_is_one_row_a_task_before_the_shuffle(spark, stage):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three four five six").alias("text"), F.col("id").alias("extra"))
    kept = stage(rows.unionByName(rows.withColumn("doc_id", F.lit(8).cast("long")).withColumn("text", F.lit("quite another text of some words"))))
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8]
    assert "partial_first" in kept._jdf.queryExecution().toString()


def test_labelled_sample_is_bounded_in_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "x"), (2, "x"), (None, "y"), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert labelled.labelled_sample(docs, labels, "toxic", F.lit(True), limit=10).count() <= 10
    every = labelled.labelled_sample(docs, labels, "toxic", F.lit(True)).collect()
    assert len(every) == 3002 and sorted((r.doc_id, r.text, r.label) for r in every if r.doc_id == 2) == [(2, "x", 1)]


@pytest.mark.parametrize("name", ["op4_toxicity", "op8_quality"])
def test_held_out_is_never_null(spark, tmp_path, name):
    docs = shared.documents(spark, "/root/testdata/sf0.001")
    docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.queries()[name](spark, f"file://{tmp_path}").collect()
    assert len(found) == 201 and all(r.held_out in (True, False) for r in found)


def test_vectors_of_any_finite_size_link(spark):
    rng = np.random.default_rng(3)
    shape = rng.normal(size=8)
    rows = [(k, (shape * size).tolist()) for k, size in enumerate([1e-300, 1e-200, 1.0, 1e154, 1e300])] + [(9, [5e-324] * 8), (10, [1.7e308] * 8), (11, [0.0] * 8)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(found[k] == (4, 0) for k in range(5)) and found[9] == found[10] == (1, 9) and found[11] == (0, 11)
