"""Panel yield, critical area, spatial yield and panel maps (all panels in one plan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import yield_models as ym
from lotwise.functions.lineage import cut
from lotwise.operators.clustering import CLUSTERS, die_clusters
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX

DIE = ["panel_id", "component_row", "component_col"]


def die_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active dies with their number of system_a defects, zero included."""
    counts = fab.defects(spark, sf_dir).filter("source_system = 'system_a'").groupBy("panel_id", "component_row", "component_col").agg(F.count("*").alias("n"))
    dies = fab.components(spark, sf_dir).filter("active")
    return dies.join(counts, ["panel_id", "component_row", "component_col"], "left").select(
        "panel_id", "substrate_type", "lot_id", "component_row", "component_col", "region_id", F.coalesce("n", F.lit(0)).alias("n_defects")
    )


def rounded(fraction: Column) -> Column:
    """Six digits, by way of ten, so that a mean on the edge of a digit doesn't depend on the order of summing."""
    return F.round(F.round(fraction, 10), 6)


def critical_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean critical fraction per panel over all system_a defects; the layout density without any."""
    found = fab.with_profile(fab.defects(spark, sf_dir).filter("source_system = 'system_a'"))
    mean = found.groupBy("panel_id").agg(F.avg(ym.critical_fraction(F.col("size"), F.col("layout_density"), F.col("min_feature"))).alias("fraction"))
    every = fab.with_profile(fab.panels(spark, sf_dir)).join(mean, "panel_id", "left")
    return every.select("panel_id", "substrate_type", F.coalesce(rounded(F.col("fraction")), "layout_density").alias("critical_fraction"))


def die_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every die with its system_a defects and their summed critical fraction: one pass over the defects.

    Dies that the components lack keep their sums, since the critical area counts defects anywhere.
    """
    found = fab.with_profile(fab.defects(spark, sf_dir).filter("source_system = 'system_a'"))
    fraction = ym.critical_fraction(F.col("size"), F.col("layout_density"), F.col("min_feature"))
    counts = found.groupBy(*DIE).agg(F.count("*").alias("n"), F.sum(fraction).alias("fraction"))
    dies = fab.components(spark, sf_dir).select(*DIE, "substrate_type", "lot_id", "region_id", "active")
    return dies.join(counts, DIE, "full").withColumn("n", F.coalesce("n", F.lit(0)))


def yields_of_dies(dies: DataFrame) -> DataFrame:
    """Panel yields from :func:`die_sums`, by one aggregate per panel."""
    n = F.when(F.col("active"), F.col("n"))
    sums = dies.groupBy("panel_id").agg(
        F.max("substrate_type").alias("substrate_type"), F.count(n).alias("inspected_dies"), F.sum(n).alias("defect_count"), F.sum(n * n).alias("squares"),
        rounded(F.sum("fraction") / F.nullif(F.sum("n"), F.lit(0))).alias("fraction"),
    )
    area = F.col("pitch") * F.col("pitch")
    base = (
        fab.with_profile(sums.filter("inspected_dies > 0"))
        .withColumn("critical_fraction", F.coalesce("fraction", "layout_density"))
        .withColumn("defect_density", F.col("defect_count") / (F.col("inspected_dies") * area))
        .withColumn("alpha", ym.counted_alpha(F.col("inspected_dies"), F.col("defect_count"), F.col("squares")))
        .withColumn("area", F.col("critical_fraction") * area)
    )
    a, d = F.col("area"), F.col("defect_density")
    return base.select(
        "panel_id", "substrate_type", "inspected_dies", "defect_count", "defect_density", "critical_fraction", "alpha",
        ym.poisson(a, d).alias("yield_poisson"), ym.murphy(a, d).alias("yield_murphy"), ym.negative_binomial(a, d, F.col("alpha")).alias("yield_negbinom"),
        ym.recommended_model(F.col("substrate_type"), F.col("alpha"), a * d).alias("recommended"),
    )


def panel_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defect density, alpha and the three yield models of every panel that has active dies."""
    return yields_of_dies(die_sums(spark, sf_dir))


def spatial_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of per-die Poisson yields against the yield at the mean density."""
    dies = fab.with_profile(die_counts(spark, sf_dir)).join(critical_area(spark, sf_dir).select("panel_id", "critical_fraction"), "panel_id")
    area = F.col("pitch") * F.col("pitch")
    per_die = dies.withColumn("d0", F.col("n_defects") / area).withColumn("die_yield", F.exp(-(F.col("critical_fraction") * area) * F.col("d0")))
    agg = per_die.groupBy("panel_id").agg(
        F.avg("die_yield").alias("spatial_yield"), F.exp(-F.first("critical_fraction") * (F.sum("n_defects") / F.count("*"))).alias("global_yield"),
        F.avg("n_defects").alias("mean_n"), F.stddev_pop("n_defects").alias("std_n"),
    )
    return agg.select(
        "panel_id", "spatial_yield", "global_yield", (F.col("spatial_yield") - F.col("global_yield")).alias("gain"),
        F.when(F.col("mean_n") > 0, F.col("std_n") / F.col("mean_n")).otherwise(0.0).alias("cv"),
    )


def spatial_dies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every die with its defects, local density and its yield by each model from the panel's critical area and alpha; an inactive die shows its defects and yields 0."""
    sums = cut(die_sums(spark, sf_dir))
    panel = yields_of_dies(sums).select("panel_id", "critical_fraction", "alpha")
    dies = fab.with_profile(sums.filter("active is not null")).join(panel, "panel_id")
    area, density = F.col("critical_fraction") * F.col("pitch") * F.col("pitch"), F.col("n") / (F.col("pitch") * F.col("pitch"))
    models = {"poisson": ym.poisson(area, density), "murphy": ym.murphy(area, density), "negbinom": ym.negative_binomial(area, density, F.col("alpha"))}
    return dies.select(*DIE, "region_id", "active", F.col("n").alias("n_defects"), density.alias("density"), *(F.when(F.col("active"), y).otherwise(0.0).alias(f"yield_{name}") for name, y in models.items()))


def panel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every die of the rows x cols grid with counts by type, dominant type, dominant cluster and Poisson yield.

    Counts are of all system_a defects, active die or not; a die without a component is inactive with an
    empty region; the yield (full area) stands where the die is active; the cluster label is null where
    nothing was clustered.
    """
    found = fab.defects(spark, sf_dir).filter("source_system = 'system_a'").groupBy(*DIE, "defect_type").agg(F.count("*").alias("n"))
    # The most frequent type, then the first name: one aggregate, no window.
    types = F.sort_array(F.collect_list(F.struct("defect_type", "n")))
    per_die = found.groupBy(*DIE).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("less"), F.col("defect_type").alias("t"))).alias("top"), types.alias("types"))
    dies = fab.components(spark, sf_dir).select(*DIE, "region_id", "active").join(per_die, DIE, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    active = F.when(F.col("active"), F.col("n"))
    density = fab.with_profile(dies.groupBy("panel_id").agg(F.sum(active).alias("found"), F.count(active).alias("dies")).join(fab.panels(spark, sf_dir).select("panel_id", "substrate_type"), "panel_id"))
    density = density.select("panel_id", F.exp(-(F.col("pitch") * F.col("pitch")) * (F.col("found") / (F.nullif("dies", F.lit(0)) * (F.col("pitch") * F.col("pitch"))))).alias("die_yield"))
    grid = fab.panels(spark, sf_dir).select("panel_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("component_row"), "cols")
    grid = grid.select("panel_id", "component_row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("component_col"))
    joined = grid.join(dies, DIE, "left").join(die_clusters(spark, sf_dir), DIE, "left").join(density, "panel_id", "left")
    is_active = F.coalesce("active", F.lit(False))
    return joined.select(
        *DIE, F.coalesce("region_id", F.lit("")).alias("region_id"), is_active.alias("active"), F.coalesce("n", F.lit(0)).alias("n_defects"), F.col("top.t").alias("dominant_type"),
        F.array_join(F.transform("types", lambda t: F.concat_ws(":", t["defect_type"], t["n"])), ",").alias("type_counts"), "cluster_label", F.when(is_active, F.col("die_yield")).alias("die_yield"),
    )


QUERIES = {"panel_yield": panel_yield, "die_counts": die_counts, "critical_area": critical_area, "spatial_yield": spatial_yield, "spatial_dies": spatial_dies, "panel_map": panel_map}

DIES = """, counts AS (SELECT panel_id, component_row, component_col, count(*) AS n FROM defects WHERE source_system = 'system_a' GROUP BY ALL),
dies AS (SELECT c.panel_id, c.substrate_type, c.lot_id, c.component_row, c.component_col, c.region_id, coalesce(n, 0)::BIGINT AS n_defects
         FROM components c LEFT JOIN counts USING (panel_id, component_row, component_col) WHERE c.active),
ca AS (SELECT p.panel_id, p.substrate_type, coalesce(round(round(f, 10), 6), layout_density) AS critical_fraction FROM panels p JOIN dim_profile USING (substrate_type)
       LEFT JOIN (SELECT panel_id, avg(CASE WHEN size <= 0 THEN layout_density ELSE least(1.0::DOUBLE, layout_density * (1 + size / min_feature)) END) AS f
                  FROM defects JOIN dim_profile USING (substrate_type) WHERE source_system = 'system_a' GROUP BY 1) USING (panel_id)),
py0 AS (SELECT panel_id, substrate_type, count(*) AS inspected_dies, sum(n_defects)::BIGINT AS defect_count, avg(n_defects) AS m, var_samp(n_defects) AS v FROM dies GROUP BY ALL),
py1 AS (SELECT p.*, critical_fraction, defect_count / (inspected_dies * (pitch * pitch)) AS defect_density, critical_fraction * (pitch * pitch) AS area,
               CASE WHEN inspected_dies < 4 OR m = 0 THEN 1.0 WHEN v <= m THEN 50.0 ELSE round(least(100.0::DOUBLE, greatest(0.05::DOUBLE, m * m / (v - m))), 4) END::DOUBLE AS alpha
        FROM py0 p JOIN dim_profile USING (substrate_type) JOIN ca USING (panel_id)),
py AS (SELECT panel_id, py1.substrate_type, inspected_dies, defect_count, defect_density, critical_fraction, alpha, exp(-area * defect_density) AS yield_poisson,
              CASE WHEN area * defect_density < 1e-10 THEN 1.0 ELSE pow((1 - exp(-(area * defect_density))) / (area * defect_density), 2.0) END AS yield_murphy,
              least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(1 + area * defect_density / alpha, -alpha))) AS yield_negbinom,
              CASE WHEN py1.substrate_type = 'wafer' THEN CASE WHEN alpha < 1 THEN 'negbinom' WHEN alpha < 10 THEN 'murphy' ELSE 'poisson' END
                   WHEN area * defect_density < 0.5 THEN 'poisson' ELSE 'murphy' END AS recommended FROM py1)
"""

ORACLE_SQL = {
    "panel_yield": PREFIX + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,") + "SELECT * FROM py",
    "die_counts": PREFIX + DIES + "SELECT * FROM dies",
    "critical_area": PREFIX + DIES + "SELECT * FROM ca",
    "spatial_yield": PREFIX
    + DIES
    + """, y AS (SELECT d.panel_id, n_defects, exp(-(critical_fraction * (pitch * pitch)) * (n_defects / (pitch * pitch))) AS die_yield, critical_fraction
          FROM dies d JOIN dim_profile USING (substrate_type) JOIN ca USING (panel_id)),
g AS (SELECT panel_id, avg(die_yield) AS spatial_yield, exp(-any_value(critical_fraction) * (sum(n_defects) / count(*))) AS global_yield, avg(n_defects) AS m, stddev_pop(n_defects) AS s FROM y GROUP BY 1)
SELECT panel_id, spatial_yield, global_yield, spatial_yield - global_yield AS gain, CASE WHEN m > 0 THEN s / m ELSE 0.0 END AS cv FROM g""",
    "spatial_dies": PREFIX + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,") + """, e AS (SELECT c.*, coalesce(n, 0) AS n, py.alpha, py.critical_fraction * pitch * pitch AS area, coalesce(n, 0) / (pitch * pitch) AS density
  FROM components c JOIN dim_profile USING (substrate_type) JOIN py USING (panel_id) LEFT JOIN counts USING (panel_id, component_row, component_col))
SELECT panel_id, component_row, component_col, region_id, active, n AS n_defects, density, CASE WHEN active THEN exp(-area * density) ELSE 0.0 END AS yield_poisson,
  CASE WHEN NOT active THEN 0.0 WHEN area * density < 1e-10 THEN 1.0 ELSE pow((1 - exp(-(area * density))) / (area * density), 2.0) END AS yield_murphy,
  CASE WHEN active THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(1 + area * density / alpha, -alpha))) ELSE 0.0 END AS yield_negbinom FROM e""",
    "panel_map": PREFIX
    + CLUSTERS
    + DIES
    + """, t AS (SELECT panel_id, component_row, component_col, defect_type, count(*) AS n FROM defects WHERE source_system = 'system_a' GROUP BY ALL),
top AS (SELECT panel_id, component_row, component_col, sum(n)::BIGINT AS total, first(defect_type ORDER BY n DESC, defect_type) AS dominant_type, string_agg(defect_type || ':' || n, ',' ORDER BY defect_type) AS type_counts FROM t GROUP BY ALL)
SELECT c.panel_id, c.component_row, c.component_col, c.region_id, c.active, coalesce(total, 0) AS n_defects, dominant_type, type_counts, cluster_label,
       CASE WHEN c.active THEN exp(-(pitch * pitch) * defect_density) END AS die_yield
FROM components c JOIN dim_profile USING (substrate_type) LEFT JOIN top USING (panel_id, component_row, component_col) LEFT JOIN dc USING (panel_id, component_row, component_col) LEFT JOIN py USING (panel_id)""",
}
