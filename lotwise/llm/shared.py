"""What the operators of this subpackage share: the shared folder, written intermediates, word hashes.

Intermediates are Parquet tables in the folder that ``spark.checkpoint.dir`` names, so a lost
executor never takes the only copy of anything with it. Where the setting is absent and the master is
local (tests, a notebook) a temporary folder is chosen once per application; a cluster without it is
refused, since its machines share no temporary folder. What nothing reads any more is discarded.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors see."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="lotwise-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, unique place under the shared folder."""
    return f"{shared_folder(spark)}/lotwise/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns a reader of it (cuts lineage)."""
    spark = df.sparkSession
    where = new_folder(spark, name)
    (df.coalesce(partitions) if partitions else df).write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder made by :func:`new_folder` or :func:`written` once nothing reads it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`written` returned, once nothing reads them."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove(table.sparkSession, folder)


def row_and_columns(docs: DataFrame, *columns: Column) -> DataFrame:
    """``docs`` with each row as the one struct ``row`` beside ``columns``, so its own names clash with nothing."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"), *columns)


def row_fields(docs: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, some replaced."""
    return [replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


#: A group that holds this share of all rows or more is joined by broadcast; there are at most 1,024.
HEAVY_SHARE = 1_024


def join_by_group(rows: DataFrame, groups: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``groups`` (a row per key), those of the keys ``heavy`` by broadcast.

    ``heavy`` holds the keys with at least 1/HEAVY_SHARE of the rows, so it has at most HEAVY_SHARE rows
    and no other group can fill a task.
    """
    marks = F.broadcast(heavy.select(*keys))
    light = rows.join(marks, keys, "left_anti").join(groups.hint("merge"), keys)
    return light.unionByName(rows.join(F.broadcast(groups.join(marks, keys, "left_semi")), keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(id_column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``: the folds of the contracts."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def smallest_hashes(columns: list[str], wanted: int, rows: int):
    """Condition that about ``wanted`` of ``rows`` rows meet, all where there are no more; it needs no sort."""
    share = min(1.0, wanted / max(rows, 1))
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) <= F.lit(min(int(2.0**63 * share), 2**63 - 1))


class BoundedCache(dict):
    """A dict that fills itself through ``compute`` and is emptied when it holds ``limit`` keys."""

    def __init__(self, compute, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


#: 64-bit hash of a word's bytes; one cache per worker process, kept small since the process outlives its stage.
word_hash = BoundedCache(xxhash.xxh64_intdigest, 100_000)

#: Texts that a worker holds as Python strings at once.
BATCH_TEXTS = 500


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, of 10,000 texts by Spark's setting, in parts of at most BATCH_TEXTS."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH_TEXTS):
            yield batch.slice(begin, BATCH_TEXTS)
