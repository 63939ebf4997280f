"""Filtered and paged lists, lookups and galleries, set operations and small distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators.yields import DIES, panel_yield
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX


def where_equal(rows: DataFrame, matched_only: bool = False, **wanted) -> DataFrame:
    """Rows whose columns equal the given values; None asks for nothing. ``matched_only`` wants a match_id."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.filter("match_id is not null and match_id <> ''") if matched_only else rows


def page_of(rows: DataFrame, order: list, page: int = 1, limit: int = 50) -> DataFrame:
    """One page in the given order with the number of all rows as ``total``.

    The sort keeps only the rows up to the page's end in each task; the total is an aggregate of one row.
    """
    if page < 1 or limit < 1:
        raise ValueError("pages and limits start at 1")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit).crossJoin(F.broadcast(total))  # one row


def lookup(rows: DataFrame, column: str, value) -> DataFrame:
    """The row with a key, or none."""
    return rows.filter(F.col(column) == value).limit(1)


def known_ids(wanted: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``wanted`` with ``found``: whether the table has the key."""
    keys = rows.select(column).distinct().withColumn("found", F.lit(True))
    return wanted.join(keys, column, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def defect_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of matched system_a defects, newest first."""
    rows = where_equal(fab.defects(spark, sf_dir), matched_only=True, source_system="system_a", panel_id=None)
    order = [F.desc(c) for c in ("created_at", "defect_key", "x", "y", "defect_type", "size", "confidence_score")]
    return page_of(rows, order, page=2).select("defect_key", "panel_id", "defect_type", "x", "y", "size", "match_id", "created_at", "total")


def panel_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of wafers, latest number first."""
    return page_of(where_equal(fab.panels(spark, sf_dir), substrate_type="wafer"), [F.desc("panel_no")], limit=20).select("panel_id", "lot_id", "product_type", "total")


def panel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order key looked up as a panel number: existence by one join."""
    wanted = fab.table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), "o_orderkey").alias("panel_id")).distinct()
    return known_ids(wanted, fab.panels(spark, sf_dir), "panel_id")


def panel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dies of one panel in row and column order."""
    rows = fab.components(spark, sf_dir).filter("panel_id = 'P3'").orderBy("component_row", "component_col")
    return rows.select("panel_id", "component_row", "component_col", "region_id", "active")


def gallery(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """The first ``top`` system_a defects of every panel with the address of their picture."""
    order = Window.partitionBy("panel_id").orderBy("defect_key", "x", "y", "defect_type", "size", "confidence_score")
    ranked = fab.defects(spark, sf_dir).filter("source_system = 'system_a'").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top)
    return ranked.select("panel_id", "k", "defect_key", "defect_type", "size", "confidence_score", F.concat(F.lit("/images/render/"), "defect_key").alias("render_url"))


def scope_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that occur in each substrate's active dies."""
    return fab.components(spark, sf_dir).filter("active").select("substrate_type", "region_id").distinct()


def defect_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by type of each panel over both systems: count, share, and the panel's top type (the first name of equals)."""
    n = fab.defects(spark, sf_dir).groupBy("panel_id", "defect_type").agg(F.count("*").alias("n"))
    top = n.groupBy("panel_id").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("less"), "defect_type")).alias("t"))
    return n.join(top, "panel_id").select(
        "panel_id", "defect_type", "n", (F.col("n") / F.col("total")).alias("share"), F.col("t.defect_type").alias("top_class"), F.round(-F.col("t.less") / F.col("total"), 4).alias("top_fraction")
    )


def type_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types per lot seen by either system, by both, and by the first alone on large defects."""
    found = fab.defects(spark, sf_dir)
    a = found.filter("source_system = 'system_a' and size > 0.048").select("lot_id", "defect_type")
    b = found.filter("source_system = 'system_b' and size > 0.048").select("lot_id", "defect_type")
    named = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "lot_id", "defect_type")
    return named(a.union(b).distinct(), "either").unionByName(named(a.intersect(b), "both")).unionByName(named(a.subtract(b), "only_a"))


def yield_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels in 20 equal bins of yield per substrate, the last one closed, empty bins included."""
    y = panel_yield(spark, sf_dir).select("substrate_type", F.least(F.width_bucket("yield_negbinom", F.lit(0.0), F.lit(1.0), F.lit(20)), F.lit(20)).cast("int").alias("bin"))
    bins = fab.lots(spark, sf_dir).select("substrate_type").distinct().select("substrate_type", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("bin"))
    return bins.join(y.groupBy("substrate_type", "bin").agg(F.count("*").alias("n")), ["substrate_type", "bin"], "left").select("substrate_type", "bin", F.coalesce("n", F.lit(0)).alias("panels"))


def yield_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated 10th, 50th and 90th percentile of panel yields per substrate."""
    p = panel_yield(spark, sf_dir).groupBy("substrate_type").agg(F.percentile("yield_negbinom", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return p.select("substrate_type", *(F.get("p", F.lit(k)).alias(f"p{n}") for k, n in enumerate((10, 50, 90))))


def scatter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, confidence and types of each panel's system_a defects."""
    found = fab.defects(spark, sf_dir).filter("source_system = 'system_a'").groupBy("panel_id")
    return found.agg(F.count("*").alias("n"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.avg("confidence_score").alias("avg_confidence"), F.count_distinct("defect_type").alias("types"))


def scatter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`scatter_summary` with the count of each type, joined as type:count by name: one aggregate per panel and type, then one per panel."""
    found = fab.defects(spark, sf_dir).filter("source_system = 'system_a'").groupBy("panel_id", "defect_type")
    types = found.agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.max("size").alias("most"), F.sum("confidence_score").alias("confidence"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("defect_type", "n"))), lambda t: F.concat_ws(":", t["defect_type"], t["n"])), ",")
    return types.groupBy("panel_id").agg(
        F.sum("n").alias("n"), (F.sum("sizes") / F.sum("n")).alias("avg_size"), F.max("most").alias("max_size"), (F.sum("confidence") / F.sum("n")).alias("avg_confidence"), listed.alias("type_counts")
    )


QUERIES = {f.__name__: f for f in (
    defect_page, panel_page, panel_lookup, panel_components, gallery, scope_regions, defect_distribution, type_sets, yield_histogram, yield_percentiles, scatter_summary, scatter_types,
)}
_YIELDS = PREFIX + DIES.replace("py1.substrate_type,", "py1.substrate_type AS substrate_type,")
_BIG = "SELECT lot_id, defect_type FROM defects WHERE size > 0.048 AND source_system = "
ORACLE_SQL = {
    "defect_page": PREFIX + """, f AS (SELECT * FROM defects WHERE source_system = 'system_a' AND match_id IS NOT NULL AND match_id <> '')
SELECT defect_key, panel_id, defect_type, x, y, size, match_id, created_at, (SELECT count(*) FROM f) AS total FROM f
ORDER BY created_at DESC, defect_key DESC, x DESC, y DESC, defect_type DESC, size DESC, confidence_score DESC LIMIT 50 OFFSET 50""",
    "panel_page": PREFIX + "SELECT panel_id, lot_id, product_type, (SELECT count(*) FROM panels WHERE substrate_type = 'wafer') AS total FROM panels WHERE substrate_type = 'wafer' ORDER BY panel_no DESC LIMIT 20",
    "panel_lookup": "SELECT DISTINCT 'P' || o_orderkey AS panel_id, o_orderkey IN (SELECT s_suppkey FROM supplier) AS found FROM orders",
    "panel_components": PREFIX + "SELECT panel_id, component_row, component_col, region_id, active FROM components WHERE panel_id = 'P3'",
    "gallery": PREFIX + """, g AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY defect_key, x, y, defect_type, size, confidence_score) AS k FROM defects WHERE source_system = 'system_a')
SELECT panel_id, k, defect_key, defect_type, size, confidence_score, '/images/render/' || defect_key AS render_url FROM g WHERE k <= 5""",
    "scope_regions": PREFIX + "SELECT DISTINCT substrate_type, region_id FROM components WHERE active",
    "defect_distribution": PREFIX + """, n AS (SELECT panel_id, defect_type, count(*) AS n FROM defects GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY panel_id) AS total, first_value(defect_type) OVER w AS top_class, first_value(n) OVER w AS most FROM n WINDOW w AS (PARTITION BY panel_id ORDER BY n DESC, defect_type))
SELECT panel_id, defect_type, n, n / total AS share, top_class, round(most / total, 4) AS top_fraction FROM r""",
    "type_sets": PREFIX + f"""SELECT 'either' AS kind, * FROM ({_BIG}'system_a' UNION {_BIG}'system_b') UNION ALL SELECT 'both', * FROM ({_BIG}'system_a' INTERSECT {_BIG}'system_b')
UNION ALL SELECT 'only_a', * FROM ({_BIG}'system_a' EXCEPT {_BIG}'system_b')""",
    "yield_histogram": _YIELDS + """SELECT s.substrate_type, b.k::INT AS bin, count(panel_id) AS panels FROM (SELECT DISTINCT substrate_type FROM lots) s CROSS JOIN range(1, 21) b(k)
LEFT JOIN py ON py.substrate_type = s.substrate_type AND least(floor(yield_negbinom * 20)::INT + 1, 20) = b.k GROUP BY ALL""",
    "yield_percentiles": _YIELDS + "SELECT substrate_type, quantile_cont(yield_negbinom, 0.1) AS p10, quantile_cont(yield_negbinom, 0.5) AS p50, quantile_cont(yield_negbinom, 0.9) AS p90 FROM py GROUP BY 1",
    "scatter_types": PREFIX + """, t AS (SELECT panel_id, defect_type, count(*) AS n FROM defects WHERE source_system = 'system_a' GROUP BY ALL), l AS (SELECT panel_id, string_agg(defect_type || ':' || n, ',' ORDER BY defect_type) AS type_counts FROM t GROUP BY 1)
SELECT panel_id, count(*) AS n, avg(size) AS avg_size, max(size) AS max_size, avg(confidence_score) AS avg_confidence, any_value(type_counts) AS type_counts FROM defects JOIN l USING (panel_id) WHERE source_system = 'system_a' GROUP BY 1""",
    "scatter_summary": PREFIX + "SELECT panel_id, count(*) AS n, avg(size) AS avg_size, max(size) AS max_size, avg(confidence_score) AS avg_confidence, count(DISTINCT defect_type) AS types FROM defects WHERE source_system = 'system_a' GROUP BY 1",
}
