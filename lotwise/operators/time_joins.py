"""Joins by time: intervals that hold a point, and the last row before a point; on tables and on two streams.

The tests' inspections are the defects with a time on the equipment's clock; a tool's log are the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.ordered import last_known, running_totals
from lotwise.plans.fab_view import table


def interval_join(points: DataFrame, intervals: DataFrame, key: str, time: str = "t", start: str = "start", end: str = "end", bucket: int = 60_000_000) -> DataFrame:
    """Every pair of a point and an interval of its key with start <= time < end, all columns of both (``key`` once).

    Times are whole numbers (microseconds). An interval lies in at most two buckets of the level whose buckets are
    at least as long as itself (``bucket`` times a power of two), and a point looks once into each level in use,
    so an interval of any length costs two rows, and a busy key is spread over its buckets. Points and intervals
    with a null key or time, and empty intervals, meet nothing; rows that repeat meet each.
    """
    clash = set(points.columns) & set(intervals.columns) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    length = F.col(end) - F.col(start)
    live = intervals.filter((length > 0) & F.col(key).isNotNull())
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(float(bucket))))).cast("int")
    levelled = live.withColumn("_level", level)
    levels = sorted(r[0] for r in levelled.select("_level").distinct().collect())  # 64 at most
    size = F.call_function("shiftleft", F.lit(bucket).cast("long"), F.col("_level"))
    at = lambda value: F.call_function("div", value - F.pmod(value, size), size)  # noqa: E731  towards minus infinity
    placed = levelled.withColumn("_bucket", F.explode(F.sequence(at(F.col(start)), at(F.col(end) - 1))))
    looked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", at(F.col(time)))
    return looked.join(placed, [key, "_level", "_bucket"]).filter((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end))).drop("_level", "_bucket")


def interval_counts(points: DataFrame, intervals: DataFrame, key: str, kind: str, time: str = "t", start: str = "start", end: str = "end") -> tuple[DataFrame, list]:
    """``points`` that meet any interval of their key, with ``n_0``, ``n_1`` ...: how many of each kind; and the kinds in that order.

    The counts of :func:`interval_join` without its pairs, whose number grows with the product of both sides: an interval
    adds one at its start and takes one off at its end, and the sum so far at a time is what goes on then. Kinds are a few names.
    """
    live = intervals.filter((F.col(end) > F.col(start)) & F.col(key).isNotNull())
    kinds = [r[0] for r in live.select(kind).distinct().orderBy(kind).collect()]  # a few names
    if not kinds:
        return points.limit(0), kinds
    step = lambda at, by: live.select(F.col(key).alias("_key"), F.col(at).alias("_t"), kind, F.lit(by).alias("_by"))
    change = [F.coalesce(F.sum(F.when(F.col(kind).eqNullSafe(F.lit(k)), F.col("_by"))), F.lit(0)).alias(f"_c{i}") for i, k in enumerate(kinds)]
    changes = step(start, 1).unionByName(step(end, -1)).groupBy("_key", "_t").agg(*change)
    known = points.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    asked = known.select(F.col(key).alias("_key"), F.col(time).alias("_t")).distinct()
    # A row per key and time, whether of a change, of points or of both, so ties of the order don't arise.
    both = changes.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    merged = both.groupBy("_key", "_t").agg(F.max("_asked").alias("_asked"), *(F.coalesce(F.sum(f"_c{i}"), F.lit(0)).alias(f"_c{i}") for i in range(len(kinds))))
    summed = running_totals(merged, "_key", ["_t"], {f"n_{i}": F.col(f"_c{i}") for i in range(len(kinds))})
    counts = [f"n_{i}" for i in range(len(kinds))]
    busy = summed.filter(F.col("_asked")).select("_key", "_t", *counts).filter(F.greatest(*counts, F.lit(0)) > 0)
    return known.join(busy, (known[key] == busy["_key"]) & (known[time] == busy["_t"])).drop("_key", "_t"), kinds


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str = "t", tie: str | None = None, tolerance: int | None = None) -> DataFrame:
    """Each row of ``left`` with ``found``, the last row of ``right`` of its key at or before its time (a struct), or null.

    Of right rows at one time the one with the greatest ``tie`` counts (any, without one). A row older than ``tolerance`` is a gap:
    null. Left rows with a null key or time stay, with null. Both sides are dealt by ranges of (key, time) and the last
    row of each range is handed on, so a key of any size is spread over tasks.
    """
    rest = [c for c in right.columns if c != key]
    value = F.struct(*(F.col(c) for c in rest))
    known = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    if tie:
        known = known.groupBy(key, F.col(time).alias("_t")).agg(F.max_by(value, F.col(tie)).alias("_value")).select(F.col(key).alias("_key"), "_t", F.lit(0).alias("_side"), "_value")
    else:
        known = known.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(0).alias("_side"), value.alias("_value"))
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_row")
    asked = left.select(F.col(key).alias("_key"), F.col(time).alias("_t"), F.lit(1).alias("_side"), row)
    both = known.unionByName(asked, allowMissingColumns=True)
    filled = last_known(both, "_key", ["_t", "_side"], "_value", "_found").filter("_side = 1")
    fits = F.col("_key").isNotNull() & F.col("_t").isNotNull()
    if tolerance is not None:
        fits &= F.col("_t") - F.col(f"_found.{time}") <= tolerance
    return filled.select(*(F.col("_row").getField(c).alias(c) for c in left.columns), F.when(fits, F.col("_found")).alias("found"))


def streamed_interval_join(points: DataFrame, intervals: DataFrame, key: str, delay: str = "1 hour", most: str = "3 hours") -> DataFrame:
    """:func:`interval_join` of two streams (or tables) with timestamps t, start and end.

    ``delay`` is how late a row of either side may come; later ones are dropped and counted in the query's
    progress (:func:`dropped_rows`). ``most`` bounds an interval's length, so that a point's state can be freed.
    """
    seen = points.withWatermark("t", delay) if points.isStreaming else points
    runs = intervals.withWatermark("start", delay) if intervals.isStreaming else intervals
    runs = runs.withColumnRenamed(key, "_key")
    inside = (F.col(key) == F.col("_key")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")) & (F.col("t") < F.col("start") + F.expr(f"INTERVAL {most}"))
    return seen.join(runs, inside).drop("_key")


def dropped_rows(query) -> int:
    """Rows that a stream's query dropped for coming after the watermark."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def clock(ts: Column) -> Column:
    """Microseconds since the log began."""
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tool, t, event_id, event_type, value of every event."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("tool"), clock(F.col("ts")).alias("t"), "event_id", "event_type", "value")


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_no, tool and t of every defect, spread over the thirty days of the log."""
    line = table(spark, sf_dir, "lineitem")
    second = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 2_592_000
    return line.select(F.col("l_suppkey").alias("panel_no"), (F.col("l_suppkey") % 10).alias("tool"), (second * 1_000_000).alias("t"))


def process_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tool, start, end, run_type: an event starts a run of one minute to two hours, a purchase one of days."""
    seconds = F.when(F.col("event_type") == "purchase", 86_400 * (1 + F.col("event_id") % 5)).otherwise(60 + F.col("event_id") * 37 % 7200)
    return tool_log(spark, sf_dir).select("tool", F.col("t").alias("start"), (F.col("t") + seconds * 1_000_000).alias("end"), F.col("event_type").alias("run_type"))


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By panel and by the last event of its tool in the six hours before each defect (none: a gap): defects, summed age and value."""
    found = asof_join(inspections(spark, sf_dir), tool_log(spark, sf_dir), "tool", tie="event_id", tolerance=6 * 3600 * 1_000_000)
    return found.groupBy("panel_no", F.col("found.event_type").alias("event_type")).agg(
        F.count("*").alias("defects"), F.sum(F.col("t") - F.col("found.t")).alias("age_us"), F.round(F.sum("found.value"), 4).alias("value")
    )


def run_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By panel and type of run: defects inspected while a run went on (a defect counts in each), and the last one's time."""
    seen, kinds = interval_counts(inspections(spark, sf_dir), process_runs(spark, sf_dir), "tool", "run_type")
    sums = [F.struct(F.lit(k).cast("string").alias("run_type"), F.sum(f"n_{i}").alias("pairs"), F.max(F.when(F.col(f"n_{i}") > 0, F.col("t"))).alias("last_us")) for i, k in enumerate(kinds)]
    empty = "array<struct<run_type:string,pairs:bigint,last_us:bigint>>"
    found = seen.groupBy("panel_no").agg(F.array(*sums).cast(empty).alias("runs"))
    return found.select("panel_no", F.explode("runs").alias("r")).select("panel_no", "r.*").filter("pairs > 0")


QUERIES = {"asof_events": asof_events, "run_defects": run_defects}
_TABLES = """WITH log AS (SELECT user_id % 10 AS tool, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t, event_id, event_type, value FROM events),
seen AS (SELECT l_suppkey AS panel_no, l_suppkey % 10 AS tool, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 2592000 * 1000000 AS t FROM lineitem)"""
ORACLE_SQL = {
    "asof_events": _TABLES + """, once AS (SELECT tool, t, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM log GROUP BY ALL),
j AS (SELECT panel_no, s.t, CASE WHEN s.t - o.t <= 21600000000 THEN o.t END AS seen_at, event_type, value FROM seen s ASOF LEFT JOIN once o ON s.tool = o.tool AND s.t >= o.t)
SELECT panel_no, CASE WHEN seen_at IS NOT NULL THEN event_type END AS event_type, count(*) AS defects, sum(t - seen_at)::BIGINT AS age_us, round(sum(value) FILTER (seen_at IS NOT NULL), 4) AS value FROM j GROUP BY ALL""",
    "run_defects": _TABLES + """, runs AS (SELECT tool, t AS start, t + CASE WHEN event_type = 'purchase' THEN 86400 * (1 + event_id % 5) ELSE 60 + event_id * 37 % 7200 END * 1000000 AS stop, event_type FROM log)
SELECT panel_no, event_type AS run_type, count(*) AS pairs, max(t) AS last_us FROM seen JOIN runs ON seen.tool = runs.tool AND t >= start AND t < stop GROUP BY ALL""",
}
