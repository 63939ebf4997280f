"""Control charts of a stream: each series keeps a small state and raises its alarms as points come.

The baseline (mean, median, sigma, moving-range limit of each scope) is a table of earlier points. A scope's
state are the number of points, the last time, the EWMA, both CUSUM arms and the last eight values; it
lives in Spark's state store, so a restarted query goes on where its checkpoint left off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lotwise.functions.lineage import cut, scratch
from lotwise.operators.ordered import in_chunks, medians, numbered
from lotwise.operators.spc import D4, SIGNALS, Chart, baseline, charts_sql, control_points
from lotwise.plans.fab_view import table

POINT = "scope string, t timestamp, point_id long, x double"
ALARM = "scope string, seq long, panel_id string, chart string, signal string, value double, control_limit double, direction string, severity string"
LIMITS = ["mean", "med", "sigma", "mr_limit"]
SEVERITY = dict(SIGNALS)


def limits_of(points: DataFrame) -> DataFrame:
    """scope and LIMITS of a table of points (scope, seq, x) whose scopes have two points or more."""
    base = baseline(points).filter("n >= 2")
    # A moving range needs the point before, which leads its chunk.
    chunks = in_chunks(points, "seq", 4096, halo=1)
    ranges = chunks.withColumn("mr", F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("scope", "chunk").orderBy("seq")))).filter("own and seq >= 2")
    joined = base.join(medians(ranges, "scope", "mr", "mr_med"), "scope")
    return joined.select("scope", "mean", "med", "sigma", F.when(F.col("mr_med") > 0, D4 * F.col("mr_med")).otherwise(D4 * F.col("sigma")).alias("mr_limit"))


class Series:
    """One scope's charts, point by point."""

    def __init__(self, chart: Chart, mean: float, med: float, sigma: float, mr_limit: float, state: tuple | None = None):
        self.chart, self.mean, self.med, self.sigma, self.mr_limit = chart, mean, med, sigma, mr_limit
        self.n, self.ewma, self.high, self.low, self.recent = state or (0, mean, 0.0, 0.0, [])

    def add(self, x: float) -> Iterator[tuple[str, str, float, float, str | None]]:
        """Takes in the next point; chart, signal, value, limit and direction of each alarm it raises."""
        chart, sigma, z = self.chart, self.sigma, x - self.mean
        moved = abs(x - self.recent[-1]) if self.recent else 0.0
        self.n += 1
        self.ewma = chart.weight * x + (1 - chart.weight) * self.ewma
        self.high = max(0.0, self.high + z - chart.slack * sigma)
        self.low = max(0.0, self.low - z - chart.slack * sigma)
        self.recent = [*self.recent, x][-8:]
        run = [v - self.mean for v in self.recent]
        beyond = lambda back, least, limit: any(sum(side * v > limit for v in run[-back:]) >= least for side in (1, -1)) and self.n >= back
        ucl = self.med + 3 * sigma
        shewhart = {
            "we1": abs(z) > 3 * sigma or x > ucl, "ratio": self.med > 0 and x > 5 * self.med, "we2": beyond(3, 2, 2 * sigma), "we3": beyond(5, 4, sigma), "we4": beyond(8, 8, 0.0),
        }
        yield from (("shewhart", signal, x, ucl, None) for signal, raised in shewhart.items() if raised)
        width = chart.width * sigma * math.sqrt(chart.weight / (2 - chart.weight) * (1 - (1 - chart.weight) ** (2 * self.n)))
        if self.ewma > self.mean + width or self.ewma < max(0.0, self.mean - width):
            yield "ewma", "ewma_signal", self.ewma, self.mean + width, None
        interval = chart.decision * sigma
        if max(self.high, self.low) > interval:
            yield "cusum", "cusum_signal", max(self.high, self.low), interval, "positive" if self.high > interval else "negative"
        if moved > self.mr_limit:
            yield "imr", "imr", moved, self.mr_limit, None


class OnlineCharts(StatefulProcessor):
    """Alarms of each scope's new points. Points of a batch go in order of (time, id); one no later than the scope's last is late: it raises ``late`` and changes nothing."""

    def __init__(self, chart: Chart):
        self.chart = chart

    def init(self, handle) -> None:
        self.state = handle.getValueState("series", "n long, ewma double, high double, low double, recent array<double>, t timestamp, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["t", "point_id"])
        held = self.state.get() if self.state.exists() else None
        first = new.iloc[0]
        series = Series(self.chart, *(float(first[c]) for c in LIMITS), state=(held[0], held[1], held[2], held[3], list(held[4])) if held else None)
        last = (pd.Timestamp(held[5]), held[6]) if held else None
        out = []
        for t, point, x in zip(new["t"], new["point_id"], new["x"], strict=True):
            if last is not None and (t, point) <= last:
                out.append((key[0], None, str(point), "late", "late", float(x), None, None, "warning"))
                continue
            last = (t, int(point))
            raised = list(series.add(float(x)))
            out += [(key[0], series.n, str(point), chart, signal, value, limit, way, SEVERITY[signal]) for chart, signal, value, limit, way in raised]
        if last is not None:
            self.state.update((series.n, series.ewma, series.high, series.low, series.recent, last[0].to_pydatetime(), last[1]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALARM.split(", ")])

    def close(self) -> None:
        pass


def online_alarms(points: DataFrame, limits: DataFrame, chart: Chart = Chart()) -> DataFrame:  # noqa: B008
    """The alarms (ALARM, as ``spc.alarms_of`` has them) of a stream of POINT rows against ``limits``.

    Points without limits, time or value are left out. The session's state store must be RocksDB's
    (:func:`use_state_store`).
    """
    live = points.filter("x is not null and t is not null").join(limits, "scope")
    raised = live.groupBy("scope").transformWithStateInPandas(OnlineCharts(chart), ALARM, "Append", "None")
    return raised.withColumns({c: F.round(c, 8) for c in ("value", "control_limit")})


def use_state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which the keyed state asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_points(events: DataFrame) -> DataFrame:
    """POINT rows of the equipment log: a series of values per event type."""
    return events.select(F.col("event_type").alias("scope"), F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("point_id"), F.col("value").alias("x"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, seq, panel_id (the event's id), x of the whole log."""
    points = event_points(table(spark, sf_dir, "events")).filter("x is not null and t is not null")
    return cut(numbered(points, "scope", ["t", "point_id"]).select("scope", "seq", F.col("point_id").cast("string").alias("panel_id"), "x"))


def spc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts of the log's values, one long series per event type."""
    found = control_points(event_series(spark, sf_dir))
    return found.select("scope", "seq", "panel_id", "x", *(F.round(c, 6).alias(c) for c in ("ewma", "cusum_hi", "cusum_lo")), "we1", "ratio", "we2", "we3", "we4", "imr", "ewma_signal", "cusum_signal")


def spc_events_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms of the log, raised by a stream over it against the limits of the whole log."""
    use_state_store(spark)
    limits = cut(limits_of(event_series(spark, sf_dir)))
    log = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(log.schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")
    folder = scratch(spark, "alarms")
    alarms = online_alarms(event_points(stream), limits)
    alarms.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ALARM).parquet(f"{folder}/out")


QUERIES = {"spc_events": spc_events, "spc_events_online": spc_events_online}
_SERIES = "WITH sr AS (SELECT event_type AS scope, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, event_id::VARCHAR AS panel_id, value AS x FROM events WHERE value IS NOT NULL AND ts IS NOT NULL)"
_CHARTS, _ALARMS = charts_sql(_SERIES, far=400)
ORACLE_SQL = {
    "spc_events": _CHARTS + "SELECT scope, seq, panel_id, x, round(ewma, 6) AS ewma, round(cusum_hi, 6) AS cusum_hi, round(cusum_lo, 6) AS cusum_lo, we1, ratio, we2, we3, we4, imr, ewma_signal, cusum_signal FROM pt",
    "spc_events_online": _CHARTS + _ALARMS,
}
