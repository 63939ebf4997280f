"""Quantiles and distinct counts over a growing history, from a sketch of each run.

A run leaves one row per key in the store: a KLL sketch of the values, a HyperLogLog sketch of the ids, and
count and extremes, some kilobytes together. Sketches merge, so figures over all runs, or any of them, come
from those rows without a second look at the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.lineage import scratch
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX
from lotwise.sources.commits import Store

#: Size of a KLL sketch, and the rank error that it keeps with 99 % (measured in the tests); bits of a HyperLogLog sketch and three times its standard error.
KLL_SIZE, RANK_ERROR = 800, 0.005
HLL_BITS, DISTINCT_ERROR = 14, 0.025


def sketch_run(rows: DataFrame, keys: list[str], value: str, distinct: str) -> DataFrame:
    """keys, values (sketch), ids (sketch), n, low and high of the rows of one run; null values and ids are left out of their sketches."""
    return rows.groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_SIZE)).alias("values"), F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(HLL_BITS)).alias("ids"),
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
    )


def append_run(store: Store, run_id: str, rows: DataFrame, keys: list[str], value: str, distinct: str) -> int:
    """Stores a run's sketches; a run that is there already is not taken twice."""
    kind = None if store.version() == 0 or "sketches" not in store.state()["tables"] else store.read("sketches")
    if kind is not None and not kind.filter(F.col("run_id") == run_id).isEmpty():
        return store.version()
    return store.transact(lambda _: {"sketches": sketch_run(rows, keys, value, distinct).withColumn("run_id", F.lit(run_id))})


def merged_runs(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key over all given runs; sketches merge by partial aggregation."""
    return sketches.filter("n > 0").groupBy(*keys).agg(
        F.kll_merge_agg_double("values", F.lit(KLL_SIZE)).alias("values"), F.hll_union_agg("ids").alias("ids"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def history_quantiles(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, share, quantile (within RANK_ERROR of its rank), distinct (within DISTINCT_ERROR), n, low, high over all given runs."""
    at = lambda q: F.col("low") if q <= 0 else F.col("high") if q >= 1 else F.kll_sketch_get_quantile_double("values", F.lit(float(q)))
    pairs = F.array(*(F.struct(F.lit(float(q)).alias("share"), at(q).cast("double").alias("quantile")) for q in shares))
    found = merged_runs(sketches, keys).withColumn("q", F.explode(pairs))
    return found.select(*keys, "q.share", "q.quantile", F.hll_sketch_estimate("ids").alias("distinct"), "n", "low", "high")


def history_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the defects of four runs, sketched one by one and merged: whether ranks and distinct panels are within the bounds, against the data itself."""
    store, found = Store(spark, scratch(spark, "sketches")), fab.defects(spark, sf_dir)
    for run in range(4):
        append_run(store, f"run-{run}", found.filter(F.col("panel_no") % 4 == run), ["substrate_type"], "x", "panel_id")
    seen = history_quantiles(store.read("sketches"), ["substrate_type"], [0.1, 0.5, 0.9])
    ranks = found.join(F.broadcast(seen.select("substrate_type", "share", "quantile")), "substrate_type").groupBy("substrate_type", "share").agg(  # three rows a substrate
        F.avg((F.col("x") < F.col("quantile")).cast("double")).alias("below"), F.avg((F.col("x") <= F.col("quantile")).cast("double")).alias("upto"), F.count_distinct("panel_id").alias("panels")
    )
    near = (F.col("below") - RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("upto") + RANK_ERROR)
    return seen.join(ranks, ["substrate_type", "share"]).select("substrate_type", "share", "n", "low", "high", near.alias("rank_within"), (F.abs(F.col("distinct") / F.col("panels") - 1) <= DISTINCT_ERROR).alias("distinct_within"))


QUERIES = {"history_percentiles": history_percentiles}
ORACLE_SQL = {"history_percentiles": PREFIX + "SELECT substrate_type, share, count(*) AS n, min(x) AS low, max(x) AS high, true AS rank_within, true AS distinct_within FROM defects, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(share) GROUP BY ALL"}
