"""Cutting lineage in iterative operators, in a way that survives lost executors, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and the master is local."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lotwise-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh, unique place under the shared folder."""
    return f"{shared_folder(spark)}/lotwise-core/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    A written table is computed once, where a checkpoint computes twice, and brings no inferred constraints
    along, which pile up over the rounds of a loop.
    """
    spark = df.sparkSession
    where = scratch(spark, "cut")
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`cut` returned, once nothing reads them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
