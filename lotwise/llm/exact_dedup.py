"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New rows are reduced to digests,
anti-joined against the index bucket by bucket (sort-merge, the index side is neither shuffled
nor sorted again) and only unseen digests are appended. Texts never travel: a row is a 32-byte
digest, an id and a length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The characters that normalisation deletes.
WHITE_SPACE = "[\\x20\\x09-\\x0D]"


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without ASCII white space; null counts as empty."""
    squeezed = F.coalesce(text, F.lit(""))
    for ch in " \n\t\r\x0b\x0c":
        squeezed = F.replace(squeezed, F.lit(ch), F.lit(""))
    return F.sha2(squeezed.cast("binary"), 256)


class DigestIndex:
    """A digest table in the session's catalog: digest, keep_id, keep_chars, group_size, and the batch that brought it.

    ``folder`` places its files; by default they go under the shared folder. Opening a folder that
    already holds an index attaches to it, so an index outlives the session that made it.
    """

    COLUMNS = "text_sha256 STRING, keep_id BIGINT, keep_chars INT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.folder = folder or shared.new_folder(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.folder}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Removes the index from the catalog and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        shared.remove(self.spark, self.folder)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the groups (:func:`group_digests`) whose digest is not in the index, under the name ``batch``; those already there stay as they are."""
        unseen = groups.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        (
            unseen.select("text_sha256", "keep_id", "keep_chars", "group_size", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "text_sha256")
            .write.bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .format("parquet")
            .mode("append")
            .option("path", self.folder)
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def digest_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, chars (code points of the original text), text_sha256."""
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.length(text_column), F.lit(0)).alias("chars"),
        text_digest(F.col(text_column)).alias("text_sha256"),
    )


def group_digests(rows: DataFrame) -> DataFrame:
    """Per digest the id that stays (most code points, then smallest id; a null id last) and the size.

    Plain partial aggregation: a digest that a third of all rows share costs one row per task.
    """
    last = F.lit(2**63 - 1).cast("long")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.coalesce("doc_id", last).alias("order"), F.col("doc_id").alias("id")))
    return (
        rows.groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), "group_size")
    )


def mark_duplicates(rows: DataFrame, groups: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Every row of ``rows`` with its group's keep_id, group_size and whether it is the one kept.

    Only a digest that came with ``batch`` has a row to keep: those that the index held before have theirs already.

    ``groups`` are the digests of ``rows``. The rows are dealt to the index's buckets, which stay where
    they are; the few digests that hold a noticeable share of the rows are joined by broadcast instead.
    Of rows that repeat an id within a group, all carry kept where the id is the kept one.
    """
    n_rows = rows.count()
    heavy = groups.filter(F.col("group_size") * shared.HEAVY_SHARE >= n_rows)
    known = index.read().select("text_sha256", "keep_id", "group_size", F.col("batch").eqNullSafe(batch).alias("new"))
    return shared.join_by_group(rows, known, heavy, ["text_sha256"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("new")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Marks every document as kept or dropped against the index, which grows by the new digests.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty; empty and
    all-white texts are one group; an empty table gives an empty result; a null id is kept only in
    a group of null ids; columns other than the two named are never looked at. With an index that
    already holds a digest, its earlier row is the keeper, new rows of that digest are dropped (also
    where a batch is delivered twice, with the same ids), and group_size counts the rows of the batch that brought the digest. Without ``index`` a fresh one
    serves this call alone.
    """
    own = index is None
    if own:
        index = DigestIndex(docs.sparkSession, buckets=int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = shared.written(digest_rows(docs, id_column, text_column), "digests")
    groups = shared.written(group_digests(rows), "digest-groups")
    batch = uuid.uuid4().hex
    index.append(groups, batch)
    marked = shared.written(mark_duplicates(rows, groups, index, batch), "marked")
    shared.discard(rows, groups)
    if own:
        index.drop()
    return marked


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The documents that exact dedup keeps, exactly one row per group of equal texts, columns unchanged.

    Null text counts as empty, so of all null, empty and white texts one stays; of rows that repeat both
    id and text one stays; an empty table stays empty; other columns, whatever their names, are kept.
    Rows are joined by (id, digest); rows that repeat both are reduced to one within each task before the
    shuffle, so a repeated row costs a row per task at most.
    """
    key = lambda digest: F.concat_ws(":", F.col("doc_id").cast("string"), digest).alias("key")
    kept = exact_dedup(docs).filter("kept").select(key(F.col("text_sha256"))).distinct()
    named = shared.row_and_columns(docs, key(text_digest(F.col("text"))))
    return named.dropDuplicates(["key"]).join(kept, "key", "left_semi").select(*shared.row_fields(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.documents(spark, sf_dir))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}

ORACLE_SQL = {
    "op9_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
