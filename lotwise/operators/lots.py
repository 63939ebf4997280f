"""Lot summaries and capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.lineage import cut
from lotwise.operators.clustering import CLUSTERS, dbscan_summary
from lotwise.operators.ordered import numbered, running_total
from lotwise.operators.yields import DIES, panel_yield
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX


def summarise(panels: DataFrame) -> DataFrame:
    """Spread of panel densities and yields per lot, and its status.

    ``panels`` has lot_id, substrate_type, panel_id, defect_density (null counts as 0), yield_negbinom and
    pattern, the panel's cluster class. With three panels or more the limits are median + 2 and + 3 times the
    MAD (at least a twentieth of the median); below, three times the profile's mean density. A clustered
    excursion comes first, then densities over the limit; densities between the limits and systematic
    clusters ask for a watch. Medians come from aggregates joined back.
    """
    rows = fab.with_profile(panels).withColumn("d", F.coalesce("defect_density", F.lit(0.0)))
    middle = rows.groupBy("lot_id").agg(F.median("d").alias("med"), F.count("*").alias("n"), F.max(3.0 * F.col("mean_count") / (F.col("pitch") * F.col("pitch"))).alias("fixed"))
    spread = rows.join(middle, "lot_id").groupBy("lot_id").agg(F.median(F.abs(F.col("d") - F.col("med"))).alias("dev"))
    mad = F.greatest(F.col("dev") * 1.4826, 0.05 * F.col("med"))
    limits = middle.join(spread, "lot_id").select(
        "lot_id", F.when(F.col("n") >= 3, F.col("med") + 3 * mad).otherwise(F.col("fixed")).alias("high"), F.when(F.col("n") >= 3, F.col("med") + 2 * mad).alias("low")
    )
    excursion, over, d = F.coalesce(F.col("pattern") == "excursion", F.lit(False)), F.col("d") > F.col("high"), F.col("d")
    agg = rows.join(limits, "lot_id").groupBy("lot_id", "substrate_type").agg(
        F.count("*").alias("panel_count"), F.avg(d).alias("avg_density"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std_density"), F.avg("yield_negbinom").alias("avg_yield"),
        F.stddev_samp("yield_negbinom").alias("std_yield"), F.count(F.when(excursion | over, 1)).alias("excursion_count"), F.count(F.when(excursion, 1)).alias("by_cluster"),
        F.count(F.when(over, 1)).alias("by_density"), F.count(F.when((d > F.col("low")) & ~over, 1)).alias("near"), F.count(F.when(F.col("pattern") == "systematic", 1)).alias("systematic"),
    )
    status = F.when(F.col("by_cluster") + F.col("by_density") > 0, "excursion").when(F.col("near") + F.col("systematic") > 0, "watch").otherwise("clean")
    return agg.withColumn("lot_status", status)


def lot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`summarise` of all panels with their yields and cluster classes."""
    classes = dbscan_summary(spark, sf_dir).select("panel_id", "pattern")
    yields = panel_yield(spark, sf_dir).select("panel_id", "defect_density", "yield_negbinom")
    placed = fab.panels(spark, sf_dir).select("panel_id", "lot_id", "substrate_type").join(yields, "panel_id", "left").join(classes, "panel_id", "left")
    return summarise(placed)


def assign_lots(waiting: DataFrame, lots: DataFrame, panels: DataFrame, lot_size: int = 25) -> DataFrame:
    """waiting panels (panel_id, substrate_type, seq) with a lot_id each: first the free places of active lots, oldest first, then new lots.

    ``lots`` has lot_id, substrate_type, lot_size, status and created_at. New ids are WL_ or GL_ with a number
    of five digits. Free places and waiting panels meet by their running numbers within a substrate, which are
    summed by ranges, so no task holds a substrate.
    """
    taken = panels.groupBy("lot_id").agg(F.count("*").alias("taken"))
    free = lots.filter("status = 'active'").join(taken, "lot_id", "left").withColumn("free", F.col("lot_size") - F.coalesce("taken", F.lit(0))).filter("free > 0")
    free = cut(free)
    places = running_total(free, "substrate_type", ["created_at", "lot_id"], F.col("free").cast("long"), "upto").select("substrate_type", "lot_id", F.explode(F.sequence(F.col("upto") - F.col("free") + 1, "upto")).alias("place"))
    in_line = numbered(waiting, "substrate_type", ["seq", "panel_id"], "place")
    full = free.groupBy("substrate_type").agg(F.sum("free").alias("places"))
    joined = in_line.join(places, ["substrate_type", "place"], "left").join(F.broadcast(full), "substrate_type", "left")  # a row per substrate
    fresh = F.floor((F.col("place") - F.coalesce("places", F.lit(0)) - 1) / lot_size) + 1
    name = F.concat(F.when(F.col("substrate_type") == "wafer", "WL_").otherwise("GL_"), F.lpad(fresh.cast("string"), 5, "0"))
    return joined.select("panel_id", "substrate_type", F.coalesce("lot_id", name).alias("lot_id"))


def lot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots for twice as many panels again: free places first, then new lots."""
    known = fab.panels(spark, sf_dir)
    waiting = known.select(F.explode(F.array(F.concat("panel_id", F.lit("x")), F.concat("panel_id", F.lit("y")))).alias("panel_id"), "substrate_type", F.col("panel_no").alias("seq"))
    lots = fab.lots(spark, sf_dir).withColumn("created_at", F.col("lot_no"))
    return assign_lots(waiting, lots.withColumn("lot_size", F.lit(6)), known, 6)


def lot_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active lots with room left, empty lots included."""
    joined = fab.lots(spark, sf_dir).join(fab.panels(spark, sf_dir).select("lot_id", "panel_id"), "lot_id", "left")
    counts = joined.filter("status = 'active'").groupBy("lot_id", "lot_size").agg(F.count("panel_id").alias("panel_count"))
    return counts.filter("panel_count < lot_size").select("lot_id", "panel_count", (F.col("lot_size") - F.col("panel_count")).alias("free"))


def latest_per_key(history: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key (max_by over a struct: partial aggregation, no window)."""
    rest = [c for c in history.columns if c not in key]
    newest = history.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(*key, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*history.columns)


def latest_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last defect of every panel, as a history table's newest row."""
    history = fab.defects(spark, sf_dir).select("panel_id", "created_at", "defect_key", "defect_type", "size")
    return latest_per_key(history, ["panel_id"], ["created_at", "defect_key"])


def lot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels, defects, sizes and confidence by lot and type, system_a."""
    found = fab.defects(spark, sf_dir).filter("source_system = 'system_a'").groupBy("lot_id", "defect_type")
    return found.agg(F.count_distinct("panel_id").alias("panels"), F.count("*").alias("n"), F.avg("size").alias("avg_size"), F.avg("confidence_score").alias("avg_confidence"), F.max("size").alias("max_size"))


def lot_trend(lots: DataFrame, summaries: DataFrame, estimates: DataFrame, limit: int = 50, most_recent: bool = False) -> DataFrame:
    """Least-squares line of mean lot density over the oldest (or most recent) ``limit`` lots of each substrate.

    ``lots`` has lot_id, substrate_type and created (its order); a lot without a row in ``summaries``
    (avg_density, avg_yield) takes the mean of all its rows in ``estimates`` (lot_id, defect_density, yield_negbinom).
    """
    window = Window.partitionBy("substrate_type").orderBy
    rank = F.row_number().over(window(F.desc("created"), F.desc("lot_id")) if most_recent else window("created", "lot_id"))
    chosen = lots.withColumn("k", rank).filter(F.col("k") <= limit)
    placed = chosen.withColumn("seq", F.row_number().over(window("created", "lot_id")))
    means = estimates.groupBy("lot_id").agg(F.avg("defect_density").alias("d2"), F.avg("yield_negbinom").alias("y2"))
    rows = placed.join(summaries.select("lot_id", "avg_density", "avg_yield"), "lot_id", "left").join(means, "lot_id", "left")
    rows = rows.select("substrate_type", "seq", F.coalesce("avg_density", "d2").alias("d"), F.coalesce("avg_yield", "y2").alias("y")).filter("d is not null")
    fit = rows.groupBy("substrate_type").agg(
        F.count("*").alias("n_lots"), F.regr_slope("d", "seq").alias("slope"), F.regr_intercept("d", "seq").alias("intercept"),
        F.regr_r2("d", "seq").alias("r2"), F.avg("d").alias("mean_density"), F.avg(F.when(F.col("y") != 0, F.col("y"))).alias("mean_yield"),
    )
    flat = F.greatest(0.05 * F.abs("mean_density"), F.lit(1e-6))
    return fit.withColumn("direction", F.when(F.col("slope") > flat, "degrading").when(F.col("slope") < -flat, "improving").otherwise("stable"))


def _trend(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    lots = fab.lots(spark, sf_dir).select("lot_id", "substrate_type", F.col("lot_no").alias("created"))
    estimates = panel_yield(spark, sf_dir).join(fab.panels(spark, sf_dir).select("panel_id", "lot_id"), "panel_id")
    # Only lots of even number have a summary; the others fall back to their estimates, which give the same means.
    summaries = lot_summary(spark, sf_dir).join(lots.filter("created % 4 < 2").select("lot_id"), "lot_id", "left_semi")
    return lot_trend(lots, summaries, estimates, **options)


def trend_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of the oldest 50 lots of each substrate."""
    return _trend(spark, sf_dir)


def trend_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of the eight most recent lots of each substrate."""
    return _trend(spark, sf_dir, limit=8, most_recent=True)


QUERIES = {"lot_summary": lot_summary, "lot_capacity": lot_capacity, "latest_estimate": latest_estimate, "lot_report": lot_report, "lot_assignment": lot_assignment, "trend_ols": trend_ols, "trend_recent": trend_recent}

#: CTEs up to ls, the lot summaries.
LOTS = PREFIX + CLUSTERS + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,") + """, lp AS (SELECT p.lot_id, p.substrate_type, p.panel_id, coalesce(defect_density, 0) AS d, yield_negbinom, pattern FROM panels p LEFT JOIN py USING (panel_id) LEFT JOIN cls USING (panel_id)),
md AS (SELECT lot_id, median(d) AS med, count(*) AS n FROM lp GROUP BY 1),
sp AS (SELECT lot_id, median(abs(d - med)) AS dev FROM lp JOIN md USING (lot_id) GROUP BY 1),
lim AS (SELECT lot_id, n, med + 3 * greatest(dev * 1.4826, 0.05 * med) AS hi, med + 2 * greatest(dev * 1.4826, 0.05 * med) AS lo FROM md JOIN sp USING (lot_id)),
jd AS (SELECT lp.*, CASE WHEN n >= 3 THEN d > hi ELSE d > 3 * mean_count / (pitch * pitch) END AS dense, n >= 3 AND d > lo AS raised FROM lp JOIN lim USING (lot_id) JOIN dim_profile USING (substrate_type)),
ls AS (SELECT lot_id, substrate_type, count(*) AS panel_count, avg(d) AS avg_density, coalesce(stddev_samp(d), 0.0) AS std_density, avg(yield_negbinom) AS avg_yield, stddev_samp(yield_negbinom) AS std_yield,
  count(*) FILTER (dense OR pattern = 'excursion') AS excursion_count, count(*) FILTER (pattern = 'excursion') AS by_cluster, count(*) FILTER (dense) AS by_density, count(*) FILTER (raised AND NOT dense) AS near,
  count(*) FILTER (pattern = 'systematic') AS systematic,
  CASE WHEN bool_or(dense OR pattern IS NOT DISTINCT FROM 'excursion') THEN 'excursion' WHEN bool_or(raised OR pattern IS NOT DISTINCT FROM 'systematic') THEN 'watch' ELSE 'clean' END AS lot_status FROM jd GROUP BY ALL)
"""


def _trend_sql(rank: str, limit: int) -> str:
    return PREFIX + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,") + f""", lm AS (SELECT lot_id, avg(defect_density) AS d, avg(yield_negbinom) AS y FROM py JOIN panels USING (panel_id) GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY substrate_type ORDER BY {rank}) AS k FROM lots), pl AS (SELECT *, row_number() OVER (PARTITION BY substrate_type ORDER BY lot_no) AS seq FROM k WHERE k <= {limit}),
f AS (SELECT substrate_type, count(*) AS n_lots, regr_slope(d, seq) AS slope, regr_intercept(d, seq) AS intercept, regr_r2(d, seq) AS r2, avg(d) AS mean_density, avg(nullif(y, 0)) AS mean_yield FROM pl JOIN lm USING (lot_id) GROUP BY 1)
SELECT *, CASE WHEN slope > greatest(0.05 * abs(mean_density), 1e-6) THEN 'degrading' WHEN slope < -greatest(0.05 * abs(mean_density), 1e-6) THEN 'improving' ELSE 'stable' END AS direction FROM f"""


ORACLE_SQL = {
    "lot_summary": LOTS + "SELECT * FROM ls",
    "lot_capacity": PREFIX + "SELECT l.lot_id, count(panel_id) AS panel_count, lot_size - count(panel_id) AS free FROM lots l LEFT JOIN panels p USING (lot_id) WHERE status = 'active' GROUP BY l.lot_id, lot_size HAVING count(panel_id) < lot_size",
    "latest_estimate": PREFIX + "SELECT panel_id, created_at, defect_key, defect_type, size FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY created_at DESC, defect_key DESC, defect_type DESC, size DESC) AS k FROM defects) WHERE k = 1",
    "lot_report": PREFIX + "SELECT lot_id, defect_type, count(DISTINCT panel_id) AS panels, count(*) AS n, avg(size) AS avg_size, avg(confidence_score) AS avg_confidence, max(size) AS max_size FROM defects WHERE source_system = 'system_a' GROUP BY ALL",
    "lot_assignment": PREFIX + """, t AS (SELECT lot_id, lot_no, substrate_type, greatest(6 - count(*), 0) AS free FROM panels JOIN lots USING (lot_id, substrate_type) GROUP BY ALL),
s AS (SELECT *, sum(free) OVER (PARTITION BY substrate_type ORDER BY lot_no) AS upto FROM t), w AS (SELECT panel_id || x AS panel_id, substrate_type, panel_no FROM panels, (VALUES ('x'), ('y')) v(x)),
n AS (SELECT *, row_number() OVER (PARTITION BY substrate_type ORDER BY panel_no, panel_id) AS place FROM w)
SELECT panel_id, n.substrate_type, coalesce((SELECT lot_id FROM s WHERE s.substrate_type = n.substrate_type AND place > upto - free AND place <= upto),
  CASE WHEN n.substrate_type = 'wafer' THEN 'WL_' ELSE 'GL_' END || lpad(((place - (SELECT max(upto) FROM s WHERE s.substrate_type = n.substrate_type) - 1) // 6 + 1)::BIGINT::VARCHAR, 5, '0')) AS lot_id FROM n""",
    "trend_ols": _trend_sql("lot_no", 50),
    "trend_recent": _trend_sql("lot_no DESC", 8),
}
