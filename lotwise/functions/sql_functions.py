"""The engine for SQL alone: yield models as session functions, the inspection tables as views, KLARF records as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from lotwise.operators import yields
from lotwise.plans import fab_view as fab
from lotwise.sources.klarf import BINARY_CLASSES, wafer_rows

#: Name, arguments, result and body of each function; bodies are plain SQL, so they are inlined and optimised like any expression.
FUNCTIONS = [
    ("yield_poisson", "area DOUBLE, density DOUBLE", "DOUBLE", "exp(-area * density)"),
    ("yield_murphy", "area DOUBLE, density DOUBLE", "DOUBLE", "CASE WHEN area * density < 1e-10D THEN 1D ELSE pow((1 - exp(-area * density)) / (area * density), 2D) END"),
    ("yield_negbinom", "area DOUBLE, density DOUBLE, alpha DOUBLE", "DOUBLE", "least(1D, greatest(0D, pow(1 + area * density / alpha, -alpha)))"),
    (
        "moments_alpha", "dies BIGINT, mean DOUBLE, variance DOUBLE", "DOUBLE",
        "CASE WHEN dies < 4 OR mean = 0 THEN 1D WHEN variance <= mean THEN 50D ELSE round(least(100D, greatest(0.05D, mean * mean / (variance - mean))), 4) END",
    ),
    (
        "counted_alpha", "dies BIGINT, total BIGINT, squares BIGINT", "DOUBLE",
        "CASE WHEN dies < 4 OR total = 0 THEN 1D WHEN CAST(dies AS DECIMAL(19,0)) * CAST(squares AS DECIMAL(19,0)) <= CAST(total AS DECIMAL(19,0)) * CAST(total + dies - 1 AS DECIMAL(19,0)) THEN 50D "
        "ELSE round(least(100D, greatest(0.05D, CAST(total AS DOUBLE) * CAST(total AS DOUBLE) * (dies - 1) / dies / "
        "CAST(CAST(dies AS DECIMAL(19,0)) * CAST(squares AS DECIMAL(19,0)) - CAST(total AS DECIMAL(19,0)) * CAST(total + dies - 1 AS DECIMAL(19,0)) AS DOUBLE))), 4) END",
    ),
    ("critical_fraction", "size DOUBLE, layout_density DOUBLE, min_feature DOUBLE", "DOUBLE", "CASE WHEN size <= 0 THEN layout_density ELSE least(1D, layout_density * (1 + size / min_feature)) END"),
    (
        "recommended_model", "substrate_type STRING, alpha DOUBLE, defects_per_die DOUBLE", "STRING",
        "CASE WHEN substrate_type = 'wafer' THEN CASE WHEN alpha < 1 THEN 'negbinom' WHEN alpha < 10 THEN 'murphy' ELSE 'poisson' END WHEN defects_per_die < 0.5D THEN 'poisson' ELSE 'murphy' END",
    ),
]
VIEWS = {"panels": fab.panels, "lots": fab.lots, "components": fab.components, "defects": fab.defects}


@udtf(returnType="lot_id string, wafer_id string, slot int, defect_id long, defect_type string, x double, y double, size double, confidence double", useArrow=False)
class Klarf2Records:
    """``klarf2_records(content)``: the defects of a 2.0 file given as its bytes; of null bytes no row. A wafer without defects gives none either."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for wafer in wafer_rows("content", bytes(content)) if content is not None else ():
            for d in wafer["defects"]:
                kind = BINARY_CLASSES.get(d["class_no"], f"class_{d['class_no']}")
                yield wafer.get("lot_id"), wafer["wafer_id"], wafer["slot"], d["defect_id"], kind, d["x"], d["y"], max(d["x_size"], d["y_size"]), d["confidence"]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("klarf2_records", Klarf2Records)


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> None:
    """The inspection tables of a folder as temporary views, and the profiles as ``dim_profile``."""
    for name, view in VIEWS.items():
        view(spark, sf_dir).createOrReplaceTempView(prefix + name)
    fab.dim_profile(spark).createOrReplaceTempView(f"{prefix}dim_profile")


def panel_yield_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yields of all panels by a query in SQL alone."""
    register(spark)
    register_views(spark, sf_dir, "fab_")
    return spark.sql("""
WITH counts AS (
  SELECT panel_id, component_row, component_col, count(*) AS n, sum(critical_fraction(size, layout_density, min_feature)) AS fraction
  FROM fab_defects JOIN fab_dim_profile USING (substrate_type) WHERE source_system = 'system_a' GROUP BY panel_id, component_row, component_col),
dies AS (
  SELECT panel_id, substrate_type, active, coalesce(n, 0) AS n, fraction FROM fab_components FULL JOIN counts USING (panel_id, component_row, component_col)),
sums AS (
  SELECT panel_id, max(substrate_type) AS substrate_type, count(*) FILTER (WHERE active) AS inspected_dies, sum(n) FILTER (WHERE active) AS defect_count,
         sum(n * n) FILTER (WHERE active) AS squares, round(round(sum(fraction) / nullif(sum(n), 0), 10), 6) AS fraction
  FROM dies GROUP BY panel_id),
base AS (
  SELECT panel_id, substrate_type, inspected_dies, defect_count, defect_count / (inspected_dies * (pitch * pitch)) AS defect_density, coalesce(fraction, layout_density) AS critical_fraction,
         counted_alpha(inspected_dies, defect_count, squares) AS alpha, pitch
  FROM sums JOIN fab_dim_profile USING (substrate_type) WHERE inspected_dies > 0),
sized AS (SELECT *, critical_fraction * (pitch * pitch) AS area FROM base)
SELECT panel_id, substrate_type, inspected_dies, defect_count, defect_density, critical_fraction, alpha, yield_poisson(area, defect_density) AS yield_poisson,
       yield_murphy(area, defect_density) AS yield_murphy, yield_negbinom(area, defect_density, alpha) AS yield_negbinom, recommended_model(substrate_type, alpha, area * defect_density) AS recommended
FROM sized""")


QUERIES = {"panel_yield_sql": panel_yield_sql}
ORACLE_SQL = {"panel_yield_sql": yields.ORACLE_SQL["panel_yield"]}
