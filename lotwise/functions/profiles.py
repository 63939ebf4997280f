"""Substrate profiles as a two-row dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values per substrate: die pitch (mm), match threshold (mm, also the default clustering
#: radius), layout density, minimum feature (mm), default alpha, mean defects per die.
PROFILES = [
    ("wafer", 28.0, 2.0, 0.30, 0.050, 0.5, 1.4),
    ("glass_panel", 370.0, 15.0, 0.55, 0.100, 1.0, 3.2),
]
SCHEMA = "substrate_type string, pitch double, match_mm double, layout_density double, min_feature double, default_alpha double, mean_count double"


def dim_profile(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, SCHEMA)
