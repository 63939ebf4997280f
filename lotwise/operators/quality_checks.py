"""Data-quality checks over the inspection model, each one row of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX

PLACE = ["panel_id", "component_row", "component_col"]


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of defects of one die, system and type at the same position to a tenth of a millimetre."""
    found = fab.defects(spark, sf_dir).groupBy(*PLACE, "source_system", "defect_type", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))
    return found.agg(F.count("*").alias("n")).filter("n > 1")


def orphan_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects whose die the component table doesn't have (here: after dropping the last column of dies)."""
    known = fab.components(spark, sf_dir).filter("component_col < 9").select(*PLACE).hint("merge")
    return fab.defects(spark, sf_dir).join(known, PLACE, "left_anti").groupBy("panel_id").agg(F.count("*").alias("orphans"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels with as many components as rows x columns ask for."""
    dies = fab.components(spark, sf_dir).groupBy("panel_id").agg(F.count("*").alias("actual"))
    joined = fab.panels(spark, sf_dir).join(dies, "panel_id", "left")
    return joined.select("panel_id", (F.col("rows") * F.col("cols")).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))


def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of the files that the defects come from."""
    return fab.table(spark, sf_dir, "lineitem").select(F.col("_metadata.file_path").alias("file_path")).distinct().withColumn("status", F.lit("processed"))


def validation_suite(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """check, metric, passed: ten rows.

    The defects are joined with their dies and grouped twice, by place (for duplicates) and by match; each
    group and the counts over it are one pass, so no check scans for itself.
    """
    found, dies, panels = fab.defects(spark, sf_dir), fab.components(spark, sf_dir), fab.panels(spark, sf_dir)
    n = F.count("*").cast("long")
    match = F.when(F.col("match_id") != "", F.col("match_id"))
    places = found.repartition(*PLACE).groupBy(*PLACE, "source_system", "defect_type", F.round("x", 1), F.round("y", 1)).agg(
        n.alias("n"), F.count(F.when((F.col("confidence_score") < 0) | (F.col("confidence_score") > 1), 1)).alias("bad")
    )
    known = places.join(dies.select(*PLACE, F.lit(1).alias("known")).hint("merge"), PLACE, "left")  # Spark takes the exploded dies for few and would broadcast them
    a, b = (F.coalesce(F.sum(F.when(F.col("source_system") == f"system_{x}", F.col("n"))), F.lit(0)) for x in "ab")
    facts = known.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("defects"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("confidence"), a.alias("a"), b.alias("b"),
    )
    sided = found.select(match.alias("m"), "source_system").filter("m is not null").groupBy("m").agg(F.min("source_system").alias("lo"), F.max("source_system").alias("hi")).filter("lo = hi").agg(n.alias("sided"))
    cover = coverage(spark, sf_dir).agg(n.alias("panels"), F.coalesce(F.sum("actual"), F.lit(0)).alias("components"), F.count(F.when(F.col("expected") != F.col("actual"), 1)).alias("uncovered"))
    listed = (input_files(spark, sf_dir) if files is None else files).agg(n.alias("files"))
    one = facts.crossJoin(sided).crossJoin(cover).crossJoin(listed)  # four frames of one row
    none = lambda c: (F.col(c) == 0)
    checks = [
        *((f"row_count_{k}", F.col(k), F.lit(True)) for k in ("panels", "components", "defects", "files")), ("duplicate_defects", F.col("duplicates"), none("duplicates")),
        ("orphan_defects", F.col("orphans"), none("orphans")), ("component_coverage", F.col("uncovered"), none("uncovered")), ("confidence_range", F.col("confidence"), none("confidence")),
        ("match_symmetry", F.col("sided"), none("sided")), ("system_balance", F.abs(F.col("a") - F.col("b")), F.col("a") >= F.col("b")),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("check"), metric.cast("long").alias("metric"), passed.alias("passed")) for k, metric, passed in checks))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def record_errors(records: DataFrame) -> DataFrame:
    """Adds ``errors``: what the five ingest rules find wrong with a record."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules = [
        F.when(blank("panel_id"), "panel_id is empty"), F.when((F.col("component_row") < 0) | (F.col("component_col") < 0) | F.col("component_row").isNull() | F.col("component_col").isNull(), "die is negative or missing"),
        F.when(~F.coalesce(F.col("source_system").isin("system_a", "system_b"), F.lit(False)), "unknown source_system"),
        F.when(~F.coalesce(F.col("size") > 0, F.lit(False)), "size is not positive"), F.when(~F.coalesce(F.col("confidence_score").between(0, 1), F.lit(False)), "confidence_score outside 0 to 1"),
    ]
    return records.withColumn("errors", F.array_compact(F.array(*rules)))


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by text when the records are shifted out of range on purpose."""
    shifted = fab.defects(spark, sf_dir).withColumn("confidence_score", F.col("confidence_score") + 0.3).withColumn("component_row", F.col("component_row") - 1)
    return record_errors(shifted).select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


QUERIES = {"near_duplicates": near_duplicates, "orphan_defects": orphan_defects, "coverage": coverage, "validation_suite": validation_suite, "ingest_errors": ingest_errors}

_DUP = """SELECT panel_id, component_row, component_col, source_system, defect_type, round(x, 1) AS x, round(y, 1) AS y, count(*) AS n FROM defects GROUP BY ALL HAVING count(*) > 1"""
ORACLE_SQL = {
    "near_duplicates": PREFIX + _DUP,
    "orphan_defects": PREFIX + "SELECT panel_id, count(*) AS orphans FROM defects d WHERE NOT EXISTS (SELECT 1 FROM components c WHERE c.panel_id = d.panel_id AND c.component_row = d.component_row AND c.component_col = d.component_col AND c.component_col < 9) GROUP BY 1",
    "coverage": PREFIX + "SELECT p.panel_id, (rows * cols)::BIGINT AS expected, (SELECT count(*) FROM components c WHERE c.panel_id = p.panel_id) AS actual FROM panels p",
    "validation_suite": PREFIX + f""", dup AS ({_DUP}), m AS (SELECT match_id FROM defects WHERE match_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_system) < 2)
SELECT 'row_count_panels' AS "check", count(*) AS metric, true AS passed FROM panels UNION ALL SELECT 'row_count_components', count(*), true FROM components
UNION ALL SELECT 'row_count_defects', count(*), true FROM defects UNION ALL SELECT 'row_count_files', 1, true UNION ALL SELECT 'duplicate_defects', count(*), count(*) = 0 FROM dup
UNION ALL SELECT 'orphan_defects', count(*), count(*) = 0 FROM defects d ANTI JOIN components c USING (panel_id, component_row, component_col)
UNION ALL SELECT 'component_coverage', count(*), count(*) = 0 FROM (SELECT panel_id FROM components GROUP BY 1 HAVING count(*) <> 100)
UNION ALL SELECT 'confidence_range', count(*), count(*) = 0 FROM defects WHERE confidence_score < 0 OR confidence_score > 1
UNION ALL SELECT 'match_symmetry', count(*), count(*) = 0 FROM m
UNION ALL SELECT 'system_balance', abs(count(*) FILTER (source_system = 'system_a') - count(*) FILTER (source_system = 'system_b')), count(*) FILTER (source_system = 'system_a') >= count(*) FILTER (source_system = 'system_b') FROM defects""",
    "ingest_errors": PREFIX + """SELECT 'die is negative or missing' AS error, count(*) AS n FROM defects WHERE component_row - 1 < 0
UNION ALL SELECT 'confidence_score outside 0 to 1', count(*) FROM defects WHERE confidence_score + 0.3::DOUBLE > 1""",
}
