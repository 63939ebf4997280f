"""Streaming over the equipment log: windows with watermarks, and file ingest with first-writer-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.plans.fab_view import table
from lotwise.sources.tables import first_writer_wins, read_or_empty


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def with_watermark(events: DataFrame, delay: str) -> DataFrame:
    """A stream gets a watermark, which asks for timestamps with a time zone; a table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def hourly(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Counts and sums per hour and event type; works on a stream and on a table."""
    seen = with_watermark(events, watermark)
    agg = seen.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    seen = with_watermark(events, watermark)
    agg = seen.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("w.start").alias("start"), "n")


def ingest_stream(new: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str, within: str | None = None):
    """Appends a stream of records to a Parquet table, each batch against what the table holds.

    A batch that is run again finds its rows there and adds none. ``within`` names a column that the key
    determines (a day, say): the table is partitioned by it, and a batch reads the keys of its own partitions alone.
    """

    def append(batch: DataFrame, _: int) -> None:
        existing = read_or_empty(batch.sparkSession, target, batch)
        if within:
            touched = [r[0] for r in batch.select(within).distinct().collect()]  # partitions of one batch
            existing = existing.filter(F.col(within).isin(touched))
        added = first_writer_wins(existing, batch, key, order).write.mode("append")
        (added.partitionBy(within) if within else added).parquet(target)

    return new.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(table(spark, sf_dir, "events"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


QUERIES = {"event_hours": event_hours, "event_sessions": event_sessions}
ORACLE_SQL = {
    "event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
