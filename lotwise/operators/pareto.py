"""Weighted Pareto rankings of defect types, overall, by zone, by system and over lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import yield_models as ym
from lotwise.operators.listing import where_equal
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX

VITAL_SHARE = 0.801


def rank_types(types: DataFrame, scope: list[str]) -> DataFrame:
    """Ranks rows of (scope, defect_type, n, avg_size, avg_confidence, area, pitch) by impact.

    Windows are over the few defect types of a scope, after aggregation.
    """
    by_impact = Window.partitionBy(*scope).orderBy(F.desc("impact"), "defect_type")
    running, whole = by_impact.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*scope)
    ranked = types.withColumn("impact", F.col("n") * F.col("avg_size") * F.col("avg_confidence"))
    total = F.greatest(F.sum("impact").over(whole), F.lit(1e-12))
    density = F.col("n") / F.col("area")
    return ranked.select(
        *scope, "defect_type", "n", "avg_size", "avg_confidence", "impact", F.row_number().over(by_impact).alias("rank"),
        (F.col("impact") / total).alias("fraction"), F.least(F.lit(1.0), F.sum("impact").over(running) / total).alias("cumulative"),
        (1 - ym.poisson(F.col("pitch") * F.col("pitch"), density)).alias("yield_loss"), (F.sum("impact").over(running) / total <= VITAL_SHARE).alias("vital_few"),
    )


def _types(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys, "defect_type").agg(F.count("*").alias("n"), F.avg("size").alias("avg_size"), F.avg("confidence_score").alias("avg_confidence"))


def pareto(spark: SparkSession, sf_dir: str, panel_id: str | None = None, substrate_type: str | None = None, source_system: str = "system_a") -> DataFrame:
    """Defect types per substrate on active dies, of one panel or substrate if named; dies are counted in the same scope."""
    scope = {"panel_id": panel_id, "substrate_type": substrate_type}
    dies = where_equal(fab.components(spark, sf_dir).filter("active"), **scope).groupBy("substrate_type").agg(F.count("*").alias("dies"))
    found = where_equal(fab.active_defects(spark, sf_dir, source_system), **scope)
    types = fab.with_profile(_types(found, "substrate_type").join(F.broadcast(dies), "substrate_type"))  # two rows
    return rank_types(types.withColumn("area", F.col("dies") * F.col("pitch") * F.col("pitch")), ["substrate_type"])


def pareto_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto(spark, sf_dir)


def pareto_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system_b's types on one panel."""
    return pareto(spark, sf_dir, panel_id="P3", source_system="system_b")


def pareto_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within each region of a substrate."""
    keys = ["substrate_type", "region_id"]
    dies = fab.components(spark, sf_dir).filter("active").groupBy(*keys).agg(F.count("*").alias("dies"))
    types = fab.with_profile(_types(fab.active_defects(spark, sf_dir), *keys).join(dies, keys))
    return rank_types(types.withColumn("area", F.greatest(F.col("dies"), F.lit(1)) * F.col("pitch") * F.col("pitch")), keys)


def system_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defect type in both inspection systems, ranked in each, and whether system_b confirms it."""
    found = fab.active_defects(spark, sf_dir, None)
    one = lambda name, own: F.count(own).alias(f"n_{name}")
    agg = []
    for name, system in (("a", "system_a"), ("b", "system_b")):
        own = F.col("source_system") == system
        agg += [one(name, F.when(own, 1)), F.avg(F.when(own, F.col("size"))).alias(f"size_{name}"), F.avg(F.when(own, F.col("confidence_score"))).alias(f"conf_{name}")]
    types = found.groupBy("defect_type").agg(*agg)
    for name in "ab":
        impact = F.round(F.coalesce(F.col(f"n_{name}") * F.col(f"size_{name}") * F.col(f"conf_{name}"), F.lit(0.0)), 4)
        rank = F.row_number().over(Window.partitionBy(F.col(f"n_{name}") > 0).orderBy(F.desc(f"impact_{name}"), "defect_type"))
        types = types.withColumn(f"impact_{name}", impact).withColumn(f"rank_{name}", F.when(F.col(f"n_{name}") > 0, rank).otherwise(999))
    rate = F.when(F.col("n_a") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("n_b") / F.when(F.col("n_a") > 0, F.col("n_a")).otherwise(1)))
    real = F.col("match_rate") >= 0.30
    return types.withColumn("match_rate", rate).select(
        "defect_type", "n_a", "n_b", "impact_a", "impact_b", "rank_a", "rank_b", "match_rate", real.alias("likely_real"),
        (~real & (F.col("n_a") >= 3)).alias("nuisance"), (real & (F.col("n_a") >= 3)).alias("killer"),
    )


def lot_pareto_trend(spark: SparkSession, sf_dir: str, top_n: int = 5) -> DataFrame:
    """The overall top types in every lot: count, impact and share of the lot's impact; zero where absent."""
    found = fab.active_defects(spark, sf_dir)
    overall = _types(found).withColumn("impact", F.col("n") * F.col("avg_size") * F.col("avg_confidence"))
    top = overall.orderBy(F.desc("impact"), "defect_type").limit(top_n).select("defect_type")
    per_lot = _types(found, "lot_id").withColumn("impact", F.col("n") * F.col("avg_size") * F.col("avg_confidence"))
    per_lot = per_lot.withColumn("lot_impact", F.sum("impact").over(Window.partitionBy("lot_id")))
    # Lots x top types: the types are ``top_n`` array entries, so this is an explode, not a join.
    names = top.agg(F.sort_array(F.collect_list("defect_type")).alias("types"))
    lots = fab.lots(spark, sf_dir).select("lot_id", "lot_no", F.lit(1).alias("one")).join(F.broadcast(names.withColumn("one", F.lit(1))), "one")
    wanted = lots.select("lot_id", "lot_no", F.explode("types").alias("defect_type"))
    return wanted.join(per_lot, ["lot_id", "defect_type"], "left").select(
        "lot_id", "lot_no", "defect_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("impact", F.lit(0.0)).alias("impact"),
        F.coalesce(F.col("impact") / F.col("lot_impact"), F.lit(0.0)).alias("fraction"),
    )


def pareto_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a top type's share falls or rises from the first half of the lots to the second."""
    trend = lot_pareto_trend(spark, sf_dir)
    order = Window.partitionBy("defect_type").orderBy("lot_no")
    placed = trend.withColumn("k", F.row_number().over(order)).withColumn("half", F.floor(F.count("*").over(Window.partitionBy("defect_type")) / 2))
    halves = placed.groupBy("defect_type").agg(F.avg(F.when(F.col("k") <= F.col("half"), F.col("fraction"))).alias("first"), F.avg(F.when(F.col("k") > F.col("half"), F.col("fraction"))).alias("second"))
    return halves.withColumn("direction", F.when(F.col("second") < 0.85 * F.col("first"), "improving").when(F.col("second") > 1.15 * F.col("first"), "degrading").otherwise("stable"))


def lot_trend(spark: SparkSession, sf_dir: str, substrate_type: str | None = None, source_system: str = "system_a", top_n: int = 5) -> DataFrame:
    """The overall top types of a substrate and system in each of its lots that has panels, oldest first: count, impact, share of the lot's impact, yield loss over the lot's dies.

    A type that a lot lacks has zeros. Impact has four digits, share four and yield loss six.
    """
    scope = {"substrate_type": substrate_type}
    found = where_equal(fab.active_defects(spark, sf_dir, source_system), **scope)
    top = _types(found).withColumn("impact", F.col("n") * F.col("avg_size") * F.col("avg_confidence")).orderBy(F.desc("impact"), "defect_type").limit(top_n)
    names = [r.defect_type for r in top.select("defect_type").collect()]  # ``top_n`` at most
    area = fab.with_profile(where_equal(fab.components(spark, sf_dir).filter("active"), **scope)).groupBy("lot_id").agg(
        F.count_distinct("panel_id").alias("panels"), F.sum(F.col("pitch") * F.col("pitch")).alias("area"), F.max(F.col("pitch") * F.col("pitch")).alias("die_area")
    )
    lots = where_equal(fab.lots(spark, sf_dir), **scope).select("lot_id", "lot_no").join(area, "lot_id").withColumn("defect_type", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    impact = F.col("n") * F.col("avg_size") * F.col("avg_confidence")
    per_lot = _types(found, "lot_id").withColumn("impact", impact).withColumn("whole", F.sum("impact").over(Window.partitionBy("lot_id")))
    n, own = F.coalesce("n", F.lit(0)), F.coalesce("impact", F.lit(0.0))
    return lots.join(per_lot, ["lot_id", "defect_type"], "left").select(
        "lot_id", "lot_no", "panels", "defect_type", n.alias("n"), F.round(own, 4).alias("impact"), F.round(own / F.greatest(F.coalesce("whole", F.lit(0.0)), F.lit(1e-12)), 4).alias("fraction"),
        F.round(1 - ym.poisson(F.col("die_area"), n / F.col("area")), 6).alias("yield_loss"),
    )


def lot_trend_glass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system_b's three top types over the glass lots."""
    return lot_trend(spark, sf_dir, "glass_panel", "system_b", 3)


def pareto_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types per substrate and per zone of a substrate in one pass over the defects: grouping sets; ``region_id`` is null for whole substrates."""
    dies = fab.components(spark, sf_dir).filter("active").groupingSets([["substrate_type", "region_id"], ["substrate_type"]], "substrate_type", "region_id").agg(F.count("*").alias("dies"))
    types = fab.active_defects(spark, sf_dir).groupingSets([["substrate_type", "region_id", "defect_type"], ["substrate_type", "defect_type"]], "substrate_type", "region_id", "defect_type").agg(
        F.count("*").alias("n"), F.avg("size").alias("avg_size"), F.avg("confidence_score").alias("avg_confidence")
    )
    level = lambda df: df.withColumn("region_id", F.coalesce("region_id", F.lit("")))  # noqa: E731  no region is empty
    joined = fab.with_profile(level(types).join(F.broadcast(level(dies)), ["substrate_type", "region_id"]))  # a row per zone
    ranked = rank_types(joined.withColumn("area", F.greatest("dies", F.lit(1)) * F.col("pitch") * F.col("pitch")), ["substrate_type", "region_id"])
    return ranked.withColumn("region_id", F.nullif("region_id", F.lit("")))


QUERIES = {
    "lot_trend_glass": lot_trend_glass, "pareto_levels": pareto_levels,
    "pareto_overall": pareto_overall, "pareto_panel": pareto_panel, "pareto_zone": pareto_zone, "system_comparison": system_comparison,
    "lot_pareto_trend": lot_pareto_trend, "pareto_direction": pareto_direction,
}


def _ranked(keys: str, types: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY impact DESC, defect_type ROWS UNBOUNDED PRECEDING)"
    t = f"greatest(sum(impact) OVER (PARTITION BY {keys}), 1e-12)"
    return PREFIX + f""", t AS (SELECT *, n * avg_size * avg_confidence AS impact FROM ({types}))
SELECT {keys}, defect_type, n, avg_size, avg_confidence, impact, row_number() OVER (PARTITION BY {keys} ORDER BY impact DESC, defect_type) AS rank,
       impact / {t} AS fraction, least(1.0::DOUBLE, sum(impact) {w} / {t}) AS cumulative, 1 - exp(-(pitch * pitch) * (n / area)) AS yield_loss,
       sum(impact) {w} / {t} <= 0.801::DOUBLE AS vital_few FROM t"""


_LOT_TREND = """, ov AS (SELECT defect_type, count(*) * avg(size) * avg(confidence_score) AS impact FROM active_a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
pl AS (SELECT lot_id, defect_type, count(*) AS n, count(*) * avg(size) * avg(confidence_score) AS impact FROM active_a GROUP BY ALL),
pl2 AS (SELECT *, sum(impact) OVER (PARTITION BY lot_id) AS lot_impact FROM pl),
trend AS (SELECT l.lot_id, lot_no, ov.defect_type, coalesce(n, 0)::BIGINT AS n, coalesce(pl2.impact, 0.0) AS impact, coalesce(pl2.impact / lot_impact, 0.0) AS fraction
          FROM lots l CROSS JOIN ov LEFT JOIN pl2 ON pl2.lot_id = l.lot_id AND pl2.defect_type = ov.defect_type)
"""

ORACLE_SQL = {
    "pareto_overall": _ranked("substrate_type", """SELECT a.substrate_type, defect_type, count(*) AS n, avg(size) AS avg_size, avg(confidence_score) AS avg_confidence, any_value(pitch) AS pitch,
  any_value(dies * pitch * pitch) AS area FROM active_a a JOIN dim_profile USING (substrate_type)
  JOIN (SELECT substrate_type, count(*) AS dies FROM components WHERE active GROUP BY 1) USING (substrate_type) GROUP BY a.substrate_type, defect_type"""),
    "pareto_panel": _ranked("substrate_type", """SELECT a.substrate_type, defect_type, count(*) AS n, avg(size) AS avg_size, avg(confidence_score) AS avg_confidence, any_value(pitch) AS pitch,
  any_value(dies * pitch * pitch) AS area FROM (SELECT d.* FROM defects d JOIN components c USING (panel_id, component_row, component_col) WHERE c.active AND panel_id = 'P3' AND source_system = 'system_b') a
  JOIN dim_profile USING (substrate_type) CROSS JOIN (SELECT count(*) AS dies FROM components WHERE active AND panel_id = 'P3') GROUP BY a.substrate_type, defect_type"""),
    "pareto_zone": _ranked("substrate_type, region_id", """SELECT a.substrate_type, a.region_id, defect_type, count(*) AS n, avg(size) AS avg_size, avg(confidence_score) AS avg_confidence, any_value(pitch) AS pitch,
  any_value(greatest(dies, 1) * pitch * pitch) AS area FROM active_a a JOIN dim_profile USING (substrate_type)
  JOIN (SELECT substrate_type, region_id, count(*) AS dies FROM components WHERE active GROUP BY ALL) USING (substrate_type, region_id) GROUP BY a.substrate_type, a.region_id, defect_type"""),
    "system_comparison": PREFIX + """, d AS (SELECT d.* FROM defects d JOIN components c USING (panel_id, component_row, component_col) WHERE c.active),
t AS (SELECT defect_type, count(*) FILTER (source_system = 'system_a') AS n_a, count(*) FILTER (source_system = 'system_b') AS n_b,
      round(coalesce(count(*) FILTER (source_system = 'system_a') * avg(size) FILTER (source_system = 'system_a') * avg(confidence_score) FILTER (source_system = 'system_a'), 0.0), 4) AS impact_a,
      round(coalesce(count(*) FILTER (source_system = 'system_b') * avg(size) FILTER (source_system = 'system_b') * avg(confidence_score) FILTER (source_system = 'system_b'), 0.0), 4) AS impact_b
      FROM d GROUP BY 1),
u AS (SELECT *, CASE WHEN n_a > 0 THEN row_number() OVER (PARTITION BY n_a > 0 ORDER BY impact_a DESC, defect_type) ELSE 999 END AS rank_a,
      CASE WHEN n_b > 0 THEN row_number() OVER (PARTITION BY n_b > 0 ORDER BY impact_b DESC, defect_type) ELSE 999 END AS rank_b,
      CASE WHEN n_a = 0 THEN 0.0 ELSE least(1.0::DOUBLE, n_b / n_a) END AS match_rate FROM t)
SELECT *, match_rate >= 0.3 AS likely_real, NOT match_rate >= 0.3 AND n_a >= 3 AS nuisance, match_rate >= 0.3 AND n_a >= 3 AS killer FROM u""",
    "lot_pareto_trend": PREFIX + _LOT_TREND + "SELECT * FROM trend",
    "lot_trend_glass": PREFIX + """, a AS (SELECT d.* FROM defects d JOIN components c USING (panel_id, component_row, component_col) WHERE c.active AND d.source_system = 'system_b' AND d.substrate_type = 'glass_panel'),
ov AS (SELECT defect_type FROM a GROUP BY 1 ORDER BY count(*) * avg(size) * avg(confidence_score) DESC, 1 LIMIT 3),
ar AS (SELECT lot_id, count(DISTINCT panel_id) AS panels, sum(pitch * pitch) AS area, max(pitch * pitch) AS die_area FROM components JOIN dim_profile USING (substrate_type) WHERE active AND substrate_type = 'glass_panel' GROUP BY 1),
pl AS (SELECT lot_id, defect_type, count(*) AS n, count(*) * avg(size) * avg(confidence_score) AS impact FROM a GROUP BY ALL), pw AS (SELECT *, sum(impact) OVER (PARTITION BY lot_id) AS whole FROM pl)
SELECT lot_id, lot_no, panels, defect_type, coalesce(n, 0) AS n, round(coalesce(impact, 0.0), 4) AS impact, round(coalesce(impact, 0.0) / greatest(coalesce(whole, 0.0), 1e-12), 4) AS fraction,
  round(1 - exp(-die_area * (coalesce(n, 0) / area)), 6) AS yield_loss FROM lots JOIN ar USING (lot_id) CROSS JOIN ov LEFT JOIN pw USING (lot_id, defect_type) WHERE lots.substrate_type = 'glass_panel'""",
    "pareto_direction": PREFIX + _LOT_TREND + """, p AS (SELECT *, row_number() OVER (PARTITION BY defect_type ORDER BY lot_no) AS k, count(*) OVER (PARTITION BY defect_type) // 2 AS half FROM trend),
h AS (SELECT defect_type, avg(fraction) FILTER (k <= half) AS first, avg(fraction) FILTER (k > half) AS second FROM p GROUP BY 1)
SELECT *, CASE WHEN second < 0.85 * first THEN 'improving' WHEN second > 1.15 * first THEN 'degrading' ELSE 'stable' END AS direction FROM h""",
}

_COLUMNS = "defect_type, n, avg_size, avg_confidence, impact, rank, fraction, cumulative, yield_loss, vital_few"
ORACLE_SQL["pareto_levels"] = f"SELECT substrate_type, NULL::VARCHAR AS region_id, {_COLUMNS} FROM ({ORACLE_SQL['pareto_overall']}) UNION ALL SELECT substrate_type, region_id, {_COLUMNS} FROM ({ORACLE_SQL['pareto_zone']})"
