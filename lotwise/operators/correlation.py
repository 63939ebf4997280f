"""Repeating die locations, spatial signatures, and comparisons between lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.yield_models import normal_cdf
from lotwise.operators.lots import LOTS, lot_summary
from lotwise.operators.yields import DIES, panel_yield
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX


def repeat_locations(spark: SparkSession, sf_dir: str, threshold: float = 0.95) -> DataFrame:
    """Die locations that are defective on at least ``threshold`` of a substrate's panels.

    Type counts are (panel, type) pairs. The dominant type of equals is the first by name.
    """
    found = fab.active_defects(spark, sf_dir)
    place = ["substrate_type", "component_row", "component_col"]
    pairs = found.select(*place, "region_id", "panel_id", "defect_type").distinct()
    per_type = pairs.groupBy(*place, "region_id", "defect_type").agg(F.count("*").alias("n"))
    top = per_type.groupBy(*place, "region_id").agg(F.sum("n").alias("pairs"), F.min(F.struct((-F.col("n")).alias("less"), "defect_type")).alias("top"))
    repeats = pairs.groupBy(*place).agg(F.count_distinct("panel_id").alias("repeat_count"))
    panels = fab.panels(spark, sf_dir).groupBy("substrate_type").agg(F.count("*").alias("panels"))
    joined = top.join(repeats, place).join(F.broadcast(panels), "substrate_type")  # two rows
    rated = joined.withColumn("repeat_rate", F.col("repeat_count") / F.col("panels")).filter(F.col("repeat_rate") >= threshold)
    return rated.select(*place, "region_id", "repeat_count", "repeat_rate", F.col("top.defect_type").alias("dominant_type"), (-F.col("top.less") / F.col("pairs")).alias("type_consistency"))


def repeat_class(spark: SparkSession, sf_dir: str, threshold: float = 0.95) -> DataFrame:
    """Pattern class per substrate from its repeating locations."""
    places = fab.active_defects(spark, sf_dir).select("substrate_type", "component_row", "component_col").distinct().groupBy("substrate_type").agg(F.count("*").alias("locations"))
    sharp = (F.col("type_consistency") > 0.8) & (F.col("repeat_rate") > 0.7)
    found = repeat_locations(spark, sf_dir, threshold).groupBy("substrate_type").agg(F.count("*").alias("systematic"), F.count_distinct(F.when(sharp, F.col("dominant_type"))).alias("sharp_types"))
    rate = F.coalesce("systematic", F.lit(0)) / F.col("locations")
    label = F.when(F.coalesce("systematic", F.lit(0)) == 0, "clean").when(F.col("sharp_types") == 1, "reticle_suspect").when(rate > 0.05, "tool_suspect").otherwise("minor_systematic")
    return places.join(found, "substrate_type", "left").select("substrate_type", "locations", F.coalesce("systematic", F.lit(0)).alias("systematic"), rate.alias("systematic_rate"), label.alias("pattern"))


def repeats_of(found: DataFrame, panels: DataFrame, scope: list[str], threshold: float = 0.5) -> DataFrame:
    """Pattern class of each scope of panels from the die locations that are defective on at least ``threshold`` of them.

    ``panels`` has the scope and panel_id, ``found`` also the die, its region and the defects' types. A scope of fewer than two
    panels is insufficient_data and has no locations.
    """
    place = [*scope, "component_row", "component_col"]
    pairs = found.select(*place, "panel_id", "defect_type").distinct()
    per_type = pairs.groupBy(*place, "defect_type").agg(F.count("*").alias("n"))
    top = per_type.groupBy(*place).agg(F.sum("n").alias("pairs"), F.min(F.struct((-F.col("n")).alias("less"), "defect_type")).alias("top"))
    repeats = pairs.select(*place, "panel_id").distinct().groupBy(*place).agg(F.count("*").alias("repeat_count"))
    sizes = panels.groupBy(*scope).agg(F.count("*").alias("panels"))
    rated = top.join(repeats, place).join(sizes.filter("panels >= 2"), scope).withColumn("rate", F.col("repeat_count") / F.col("panels"))
    systematic = F.col("rate") >= threshold
    sharp = systematic & (-F.col("top.less") / F.col("pairs") > 0.8) & (F.col("rate") > 0.7)
    agg = rated.groupBy(*scope).agg(F.count("*").alias("locations"), F.count(F.when(systematic, 1)).alias("systematic"), F.count_distinct(F.when(sharp, F.col("top.defect_type"))).alias("sharp"))
    joined = sizes.join(agg, scope, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("locations", "systematic", "sharp")})
    share = F.coalesce(F.try_divide("systematic", "locations"), F.lit(0.0))
    label = F.when(F.col("panels") < 2, "insufficient_data").when(F.col("systematic") == 0, "clean").when(F.col("sharp") == 1, "reticle_suspect").when(share > 0.05, "tool_suspect").otherwise("minor_systematic")
    return joined.select(*scope, "panels", "locations", "systematic", share.alias("systematic_rate"), label.alias("pattern"))


def repeat_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every lot, by each inspection system."""
    system = F.explode(F.array(F.lit("system_a"), F.lit("system_b"))).alias("source_system")
    panels = fab.panels(spark, sf_dir).select("lot_id", "panel_id", system)
    return repeats_of(fab.active_defects(spark, sf_dir, None), panels, ["lot_id", "source_system"])


def signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial signatures that each panel's defects match, with confidence."""
    found = fab.active_defects(spark, sf_dir)
    zones = ["zone_center", "zone_mid", "zone_edge", "region_NE", "region_NW", "region_SE", "region_SW"]
    shares = [F.round(F.count(F.when(F.col("region_id") == z, 1)) / F.count("*"), 4).alias(z) for z in zones]
    agg = found.groupBy("panel_id", "substrate_type").agg(
        F.count("*").alias("n"), *shares, F.count_distinct("region_id").alias("zones"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy")
    )
    wafer = F.col("substrate_type") == "wafer"
    conf = lambda value, floor, span: F.least(F.lit(1.0), (value - floor) / span + 0.5)
    low, high = F.least("dx", "dy"), F.greatest("dx", "dy")
    center, mid, edge = (F.col(z) for z in zones[:3])
    first = F.coalesce(*(F.when(F.col(z) > 0.6, F.col(z)) for z in zones[3:]))
    rule = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("signature"), value.alias("confidence")))
    matches = F.array_compact(F.array(
        rule(wafer & (center > 0.4), "center_cluster", conf(center, 0.4, 0.4)), rule(wafer & (edge > 0.4), "edge_cluster", conf(edge, 0.4, 0.4)),
        rule(wafer & (mid > 0.5) & (mid > center) & (mid > edge), "ring_pattern", conf(mid, 0.5, 0.3)),
        rule((F.col("n") >= 5) & (low > 0) & (high / F.when(low > 0, low).otherwise(1.0) > 4), "linear_scratch", F.least(F.lit(1.0), (high / F.when(low > 0, low).otherwise(1.0) - 4) / 6 + 0.5)),
        rule(~wafer & first.isNotNull(), "quadrant_bias", conf(first, 0.6, 0.3)),
    ))
    spread = sum((F.when(F.col(z) > 0, F.abs(F.col(z) - 1 / F.col("zones"))).otherwise(0.0) for z in zones), F.lit(0.0)) / F.col("zones")
    with_all = agg.withColumn("matches", matches).withColumn("unevenness", spread)
    scatter = F.struct(F.lit("random_scatter").alias("signature"), (0.9 - F.col("unevenness") * 2).alias("confidence"))
    final = F.when((F.size("matches") == 0) & (F.col("unevenness") < 0.2), F.array(scatter)).otherwise(F.col("matches"))
    return with_all.select("panel_id", "substrate_type", F.explode(final).alias("m")).select("panel_id", "substrate_type", "m.signature", F.round("m.confidence", 3).alias("confidence"))


def welch_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's t, degrees of freedom, approximate p and Cohen's d between lots of one substrate.

    The pairs are of lot aggregates within a substrate, not of panels.
    """
    y = panel_yield(spark, sf_dir).join(fab.panels(spark, sf_dir).select("panel_id", "lot_id"), "panel_id")
    lots = y.groupBy("lot_id", "substrate_type").agg(F.count("*").alias("n"), F.avg("yield_negbinom").alias("m"), F.var_samp("yield_negbinom").alias("v")).filter("n >= 2 and v > 0")
    a, b = (lots.select("substrate_type", *(F.col(c).alias(f"{c}_{k}") for c in ("lot_id", "n", "m", "v"))) for k in "ab")
    pairs = a.join(b, "substrate_type").filter("lot_id_a < lot_id_b")
    ea, eb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    t = (F.col("m_a") - F.col("m_b")) / F.sqrt(ea + eb)
    df = (ea + eb) * (ea + eb) / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1))
    d = (F.col("m_a") - F.col("m_b")) / F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    stats = pairs.select("lot_id_a", "lot_id_b", t.alias("t"), df.alias("df"), d.alias("d"))
    z = F.abs("t") * F.sqrt(F.col("df") / (F.col("df") + F.col("t") * F.col("t") - 1 + 1e-9))
    effect = F.when(F.abs("d") < 0.2, "negligible").when(F.abs("d") < 0.5, "small").when(F.abs("d") < 0.8, "medium").otherwise("large")
    return stats.withColumn("p", 2 * (1 - normal_cdf(z))).withColumn("effect", effect)


def yield_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels per fifth of the yield range; a yield of exactly 1 is in none."""
    k = F.floor(F.col("yield_negbinom") * 5).cast("int")
    return panel_yield(spark, sf_dir).filter("yield_negbinom < 1").groupBy("substrate_type", k.alias("bucket")).agg(F.count("*").alias("panels"))


def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of a tenth of a lot's largest system_a defect."""
    found = fab.defects(spark, sf_dir).filter("source_system = 'system_a'").select("lot_id", "size")
    top = found.groupBy("lot_id").agg(F.max("size").alias("largest"))
    k = F.least(F.floor(F.col("size") / (F.col("largest") / 10)), F.lit(9)).cast("int")
    return found.join(top, "lot_id").groupBy("lot_id", k.alias("bin")).agg(F.count("*").alias("n"))


def fleet_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of lot yields, lots by status, and lots with high, middle and low yield."""
    y, status = F.col("avg_yield"), F.col("lot_status")
    return lot_summary(spark, sf_dir).agg(
        F.count("*").alias("lots"), F.avg(y).alias("mean_yield"), *(F.count(F.when(status == s, 1)).alias(s) for s in ("clean", "watch", "excursion")),
        F.count(F.when(y >= 0.5, 1)).alias("high"), F.count(F.when((y < 0.5) & (y >= 0.25), 1)).alias("mid"), F.count(F.when(y < 0.25, 1)).alias("low"),
    )


QUERIES = {f.__name__: f for f in (repeat_locations, repeat_class, repeat_lots, signature_match, welch_lots, yield_buckets, size_histogram, fleet_kpis)}

REPEAT = PREFIX + """, pr AS (SELECT DISTINCT substrate_type, component_row, component_col, region_id, panel_id, defect_type FROM active_a),
ptn AS (SELECT substrate_type, component_row, component_col, region_id, defect_type, count(*) AS n FROM pr GROUP BY ALL),
tp AS (SELECT *, sum(n) OVER w AS pairs, row_number() OVER (PARTITION BY substrate_type, component_row, component_col ORDER BY n DESC, defect_type) AS k FROM ptn WINDOW w AS (PARTITION BY substrate_type, component_row, component_col)),
rp AS (SELECT substrate_type, component_row, component_col, count(DISTINCT panel_id) AS repeat_count FROM pr GROUP BY ALL),
rl AS (SELECT substrate_type, component_row, component_col, region_id, repeat_count, repeat_count / panels AS repeat_rate, defect_type AS dominant_type, n / pairs AS type_consistency
  FROM tp JOIN rp USING (substrate_type, component_row, component_col) JOIN (SELECT substrate_type, count(*) AS panels FROM panels GROUP BY 1) USING (substrate_type) WHERE k = 1 AND repeat_count / panels >= 0.95::DOUBLE)
"""
YIELDS = PREFIX + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,")
_Q = ["region_NE", "region_NW", "region_SE", "region_SW"]
_Z = ["zone_center", "zone_mid", "zone_edge", *_Q]
_FIRST = "coalesce(" + ", ".join(f"CASE WHEN {z} > 0.6 THEN {z} END" for z in _Q) + ")"
ORACLE_SQL = {
    "repeat_locations": REPEAT + "SELECT * FROM rl",
    "repeat_class": REPEAT + """, pl AS (SELECT substrate_type, count(*) AS locations FROM rp GROUP BY 1),
f AS (SELECT substrate_type, count(*) AS systematic, count(DISTINCT CASE WHEN type_consistency > 0.8 AND repeat_rate > 0.7 THEN dominant_type END) AS sharp FROM rl GROUP BY 1)
SELECT substrate_type, locations, coalesce(systematic, 0) AS systematic, coalesce(systematic, 0) / locations AS systematic_rate,
  CASE WHEN coalesce(systematic, 0) = 0 THEN 'clean' WHEN sharp = 1 THEN 'reticle_suspect' WHEN coalesce(systematic, 0) / locations > 0.05 THEN 'tool_suspect' ELSE 'minor_systematic' END AS pattern FROM pl LEFT JOIN f USING (substrate_type)""",
    "repeat_lots": PREFIX + """, f AS (SELECT d.* FROM defects d JOIN components c USING (panel_id, component_row, component_col) WHERE c.active), sz AS (SELECT lot_id, s AS source_system, count(*) AS panels FROM panels, (VALUES ('system_a'), ('system_b')) v(s) GROUP BY ALL),
q AS (SELECT DISTINCT lot_id, source_system, component_row, component_col, panel_id, defect_type FROM f), t AS (SELECT lot_id, source_system, component_row, component_col, defect_type, count(*) AS n FROM q GROUP BY ALL),
u AS (SELECT *, sum(n) OVER w AS pairs, row_number() OVER (PARTITION BY lot_id, source_system, component_row, component_col ORDER BY n DESC, defect_type) AS k FROM t WINDOW w AS (PARTITION BY lot_id, source_system, component_row, component_col)),
r AS (SELECT lot_id, source_system, component_row, component_col, count(DISTINCT panel_id) AS c FROM q GROUP BY ALL),
g AS (SELECT lot_id, source_system, count(*) AS locations, count(*) FILTER (c / panels >= 0.5) AS systematic, count(DISTINCT CASE WHEN c / panels >= 0.5 AND n / pairs > 0.8 AND c / panels > 0.7 THEN defect_type END) AS sharp
  FROM u JOIN r USING (lot_id, source_system, component_row, component_col) JOIN sz USING (lot_id, source_system) WHERE k = 1 AND panels >= 2 GROUP BY ALL)
SELECT lot_id, source_system, panels, coalesce(locations, 0) AS locations, coalesce(systematic, 0) AS systematic, coalesce(systematic / locations, 0.0) AS systematic_rate,
  CASE WHEN panels < 2 THEN 'insufficient_data' WHEN coalesce(systematic, 0) = 0 THEN 'clean' WHEN sharp = 1 THEN 'reticle_suspect' WHEN systematic / locations > 0.05 THEN 'tool_suspect' ELSE 'minor_systematic' END AS pattern
FROM sz LEFT JOIN g USING (lot_id, source_system)""",
    "signature_match": PREFIX + f""", ag AS (SELECT panel_id, substrate_type, count(*) AS n, {", ".join(f"round(count(*) FILTER (region_id = '{z}') / count(*), 4) AS {z}" for z in _Z)},
  count(DISTINCT region_id) AS zones, least(max(x) - min(x), max(y) - min(y)) AS low, greatest(max(x) - min(x), max(y) - min(y)) AS high FROM active_a GROUP BY ALL),
mt AS (SELECT panel_id, substrate_type, 'center_cluster' AS signature, least(1.0::DOUBLE, (zone_center - 0.4) / 0.4 + 0.5) AS c FROM ag WHERE substrate_type = 'wafer' AND zone_center > 0.4
  UNION ALL SELECT panel_id, substrate_type, 'edge_cluster', least(1.0::DOUBLE, (zone_edge - 0.4) / 0.4 + 0.5) FROM ag WHERE substrate_type = 'wafer' AND zone_edge > 0.4
  UNION ALL SELECT panel_id, substrate_type, 'ring_pattern', least(1.0::DOUBLE, (zone_mid - 0.5) / 0.3 + 0.5) FROM ag WHERE substrate_type = 'wafer' AND zone_mid > 0.5 AND zone_mid > zone_center AND zone_mid > zone_edge
  UNION ALL SELECT panel_id, substrate_type, 'linear_scratch', least(1.0::DOUBLE, (high / low - 4) / 6 + 0.5) FROM ag WHERE n >= 5 AND low > 0 AND high / low > 4
  UNION ALL SELECT panel_id, substrate_type, 'quadrant_bias', least(1.0::DOUBLE, ({_FIRST} - 0.6) / 0.3 + 0.5) FROM ag WHERE substrate_type <> 'wafer' AND {_FIRST} IS NOT NULL),
un AS (SELECT *, ({" + ".join(f"CASE WHEN {z} > 0 THEN abs({z} - 1 / zones) ELSE 0.0 END" for z in _Z)}) / zones AS u FROM ag)
SELECT panel_id, substrate_type, signature, round(c, 3) AS confidence FROM mt
UNION ALL SELECT panel_id, substrate_type, 'random_scatter', round(0.9 - u * 2, 3) FROM un WHERE u < 0.2 AND panel_id NOT IN (SELECT panel_id FROM mt)""",
    "welch_lots": YIELDS + """, l AS (SELECT lot_id, p.substrate_type, count(*) AS n, avg(yield_negbinom) AS m, var_samp(yield_negbinom) AS v FROM py JOIN panels p USING (panel_id) GROUP BY ALL HAVING count(*) >= 2 AND var_samp(yield_negbinom) > 0),
s AS (SELECT a.lot_id AS lot_id_a, b.lot_id AS lot_id_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
  (a.v / a.n + b.v / b.n) * (a.v / a.n + b.v / b.n) / ((a.v / a.n) * (a.v / a.n) / (a.n - 1) + (b.v / b.n) * (b.v / b.n) / (b.n - 1)) AS df,
  (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM l a JOIN l b ON a.substrate_type = b.substrate_type AND a.lot_id < b.lot_id),
z AS (SELECT *, abs(t) * sqrt(df / (df + t * t - 1 + 1e-9)) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * (abs(t) * sqrt(df / (df + t * t - 1 + 1e-9)) / sqrt(2.0::DOUBLE))) AS k FROM s)
SELECT lot_id_a, lot_id_b, t, df, d, 2 * (1 - 0.5 * (1 + (1 - ((((1.061405429::DOUBLE * k - 1.453152027::DOUBLE) * k + 1.421413741::DOUBLE) * k - 0.284496736::DOUBLE) * k + 0.254829592::DOUBLE) * k * exp(-x * x)))) AS p,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM z""",
    "yield_buckets": YIELDS + "SELECT substrate_type, floor(yield_negbinom * 5)::INT AS bucket, count(*) AS panels FROM py WHERE yield_negbinom < 1 GROUP BY ALL",
    "size_histogram": PREFIX + ", d AS (SELECT lot_id, size, max(size) OVER (PARTITION BY lot_id) AS largest FROM defects WHERE source_system = 'system_a') SELECT lot_id, least(floor(size / (largest / 10)), 9)::INT AS bin, count(*) AS n FROM d GROUP BY ALL",
    "fleet_kpis": LOTS + """SELECT count(*) AS lots, avg(avg_yield) AS mean_yield, count(*) FILTER (lot_status = 'clean') AS clean, count(*) FILTER (lot_status = 'watch') AS watch, count(*) FILTER (lot_status = 'excursion') AS excursion,
  count(*) FILTER (avg_yield >= 0.5) AS high, count(*) FILTER (avg_yield < 0.5 AND avg_yield >= 0.25) AS mid, count(*) FILTER (avg_yield < 0.25) AS low FROM ls""",
}
