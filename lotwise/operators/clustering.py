"""Density clustering of all panels at once.

A panel of some thousand points fits into a task and is labelled there with NumPy; a larger one, which
could be a third of all points, goes through joins over small cells, where work grows with the points,
however dense they lie. Both give the same labels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions.lineage import cut
from lotwise.operators.ordered import numbered
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX


#: A panel of at most so many points is labelled in one task (a Boolean matrix of its square, 16 MB).
TASK_POINTS = 4_000


def dbscan(points: DataFrame, min_samples: int, task_points: int = TASK_POINTS) -> DataFrame:
    """panel_id, idx, label: clusters numbered by their first core point in scan order; noise is -1.

    A border point joins the lowest-numbered cluster that reaches it. ``points`` is read more than once.
    """
    large = points.groupBy("panel_id").agg(F.count("*").alias("n")).filter(F.col("n") > task_points).select("panel_id")
    if large.isEmpty():
        return label_in_tasks(points, min_samples)
    large = cut(large)
    return label_in_tasks(points.join(large, "panel_id", "left_anti"), min_samples).unionByName(label_by_cells(cut(points.join(large, "panel_id", "left_semi")), min_samples))


def label_panel(x: np.ndarray, y: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels of one panel's points, which are in scan order: smallest labels spread over core links, with pointer jumping."""
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= eps * eps
    core = near.sum(axis=1) >= min_samples
    n, root = len(x), np.arange(len(x))
    links = near & core & core[:, None]
    while True:
        lower = np.where(links, root, n).min(axis=1, initial=n)
        step = np.minimum(root, np.where(core, lower, root))
        step = np.minimum(step, step[step])
        if (step == root).all():
            break
        root = step
    heads = np.unique(root[core])
    label = np.where(core, np.searchsorted(heads, root), n)
    reached = np.where(near & core, label, n).min(axis=1, initial=n)
    return np.where(core, label, np.where(reached < n, reached, -1))


def label_in_tasks(points: DataFrame, min_samples: int) -> DataFrame:
    """:func:`dbscan` of panels whose points fit into a task."""

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("idx")
        labels = label_panel(own["x"].to_numpy(), own["y"].to_numpy(), float(own["eps"].iloc[0]), min_samples)
        return pd.DataFrame({"panel_id": own["panel_id"].to_numpy(), "idx": own["idx"].to_numpy(), "label": labels})

    return points.groupBy("panel_id").applyInPandas(label, "panel_id string, idx int, label int")


#: A cell's side over the radius: its points surely lie within the radius of each other, whatever the rounding.
CELL_SIDE = math.sqrt(0.5) * (1 - 1e-12)
CELL = ["panel_id", "cx", "cy"]


def boxes_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The extent of the points of each key: x0, x1, y0, y1."""
    return rows.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("eps").alias("eps"))


def judged(pairs: DataFrame) -> DataFrame:
    """Box pairs (columns of the second end with _b) with ``linked``: true where all their points are within the radius, false where none are, else null."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0_b") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"{c}1_b"))
    span = lambda c: F.greatest(F.col(f"{c}1_b") - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0_b"))
    reach = F.col("eps") * F.col("eps")
    far, near = gap("x") * gap("x") + gap("y") * gap("y") > reach, span("x") * span("x") + span("y") * span("y") <= reach
    return pairs.withColumn("linked", F.when(near, True).when(far, False))


def close_pairs(few: DataFrame, many: DataFrame) -> DataFrame:
    """panel_id, a, b and b's columns: points of ``few`` with those of ``many`` within the radius, which lie at most two cells away.

    Where a cell of ``few`` holds less than a fixed number of points, so is each point of ``many`` in a fixed number of pairs.
    """
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))
    around = few.withColumn("step", F.explode(steps)).select(
        "panel_id", F.col("idx").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), (F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy")
    )
    dx, dy = F.col("xa") - F.col("x"), F.col("ya") - F.col("y")
    return around.join(many, CELL).filter(dx * dx + dy * dy <= F.col("eps") * F.col("eps")).withColumnRenamed("idx", "b")


def linked_cells(core: DataFrame) -> DataFrame:
    """panel_id, a, b: cells (by their root, the smallest idx of their core points) that have core points within the radius of each other.

    Neighbouring cells are compared by the extents of their core points. Where these leave it open, the cells are cut
    into eighths and the pairs of parts compared, and so on; a part of one place is decided exactly. Only parts
    at the border of the radius stay open, so no pairs of points are made.
    """
    half = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if i or j > 0))
    cells = cut(boxes_of(core, *CELL, "root"))
    other = cells.select("panel_id", *(F.col(c).alias(f"{c}_b") for c in ("cx", "cy", "root", "x0", "x1", "y0", "y1")))
    moved = cells.withColumn("step", F.explode(half)).withColumns({"cx_b": F.col("cx") + F.col("step.i"), "cy_b": F.col("cy") + F.col("step.j")})
    tested = cut(judged(moved.join(other, ["panel_id", "cx_b", "cy_b"])).select("panel_id", "root", "root_b", "linked"))
    found = [tested.filter("linked").select("panel_id", "root", "root_b")]
    still = tested.filter("linked is null").select("panel_id", "root", "root_b", *(F.lit(0).cast("long").alias(c) for c in ("fx", "fy", "fx_b", "fy_b")))
    parts = core.withColumns({"fx": F.lit(0).cast("long"), "fy": F.lit(0).cast("long")})
    scale = 1
    while not still.isEmpty():
        scale *= 8
        part = lambda c, scale=scale: F.floor(F.col(c) / F.col("side") * scale)
        ends = still.select("panel_id", "root", "fx", "fy").unionByName(still.select("panel_id", *(F.col(f"{c}_b").alias(c) for c in ("root", "fx", "fy")))).distinct()
        parts = cut(parts.join(ends, ["panel_id", "root", "fx", "fy"], "left_semi").withColumns({"gx": part("x"), "gy": part("y")}))
        boxes = cut(boxes_of(parts, "panel_id", "root", "fx", "fy", "gx", "gy"))
        second = boxes.select("panel_id", *(F.col(c).alias(f"{c}_b") for c in ("root", "fx", "fy", "gx", "gy", "x0", "x1", "y0", "y1")))
        pairs = still.join(boxes, ["panel_id", "root", "fx", "fy"]).join(second, ["panel_id", "root_b", "fx_b", "fy_b"])
        tested = cut(judged(pairs).select("panel_id", "root", "root_b", "gx", "gy", "gx_b", "gy_b", "linked").filter("linked is null or linked"))
        hits = tested.filter("linked").select("panel_id", "root", "root_b").distinct()
        found.append(hits)
        open_pairs = tested.filter("linked is null").join(hits, ["panel_id", "root", "root_b"], "left_anti")
        still = cut(open_pairs.select("panel_id", "root", "root_b", *(F.col(f"g{c}").alias(f"f{c}") for c in ("x", "y", "x_b", "y_b"))))
        parts = parts.drop("fx", "fy").withColumnsRenamed({"gx": "fx", "gy": "fy"})
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.withColumnsRenamed({"root": "a", "root_b": "b"})


def label_by_cells(points: DataFrame, min_samples: int) -> DataFrame:
    """:func:`dbscan` of panels of any size and density.

    Points of a cell are near each other, so a cell of ``min_samples`` points has core points alone, and the
    points of the others are few in each cell: only these are paired with points around them, to count or to find a
    core point. Clusters are components of cells, by rounds of smallest-label joins with pointer jumping.
    """
    side = F.col("eps") * CELL_SIDE
    cell = cut(points.withColumn("side", side).withColumns({"cx": F.floor(F.col("x") / F.col("side")), "cy": F.floor(F.col("y") / F.col("side"))}))
    sizes = cell.groupBy(*CELL).agg(F.count("*").alias("n"))
    placed = cut(cell.join(sizes, CELL))
    thin = placed.filter(F.col("n") < min_samples).drop("n")
    counted = close_pairs(thin, placed.drop("n")).groupBy("panel_id", F.col("a").alias("idx")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_samples).select("panel_id", "idx")
    core = placed.filter(F.col("n") >= min_samples).drop("n").unionByName(thin.join(counted, ["panel_id", "idx"]).select(*thin.columns))
    roots = cut(core).groupBy(*CELL).agg(F.min("idx").alias("root"))
    core = cut(core.join(roots, CELL))
    one_way = linked_cells(core)
    links = cut(one_way.unionByName(one_way.select("panel_id", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(core.select("panel_id", F.col("root").alias("a"), F.col("root").alias("b"))).distinct())
    labels = cut(links.groupBy("panel_id", F.col("a").alias("idx")).agg(F.min("b").alias("root")))
    while True:
        near = links.join(labels.withColumnRenamed("idx", "b"), ["panel_id", "b"]).groupBy("panel_id", F.col("a").alias("idx")).agg(F.min("root").alias("near"))
        up = labels.select("panel_id", F.col("idx").alias("near"), F.col("root").alias("up"))
        step = cut(labels.join(near, ["panel_id", "idx"]).join(up, ["panel_id", "near"]).select("panel_id", "idx", F.col("root").alias("old"), F.least("near", "up").alias("root")))
        labels = step.select("panel_id", "idx", "root")
        if step.filter("old <> root").isEmpty():
            break
    heads = numbered(labels.select("panel_id", "root").distinct(), "panel_id", ["root"], "label").withColumn("label", (F.col("label") - 1).cast("int"))
    named = labels.join(heads, ["panel_id", "root"]).select("panel_id", F.col("idx").alias("root"), "label")
    labelled = cut(core.join(named, ["panel_id", "root"]).drop("root"))
    border = close_pairs(thin.join(counted, ["panel_id", "idx"], "left_anti"), labelled).groupBy("panel_id", F.col("a").alias("idx")).agg(F.min("label").alias("reached"))
    own = labelled.select("panel_id", "idx", F.col("label").alias("own"))
    joined = points.select("panel_id", "idx").join(own, ["panel_id", "idx"], "left").join(border, ["panel_id", "idx"], "left")
    return joined.select("panel_id", "idx", F.coalesce("own", "reached", F.lit(-1)).alias("label"))


def panel_points(spark: SparkSession, sf_dir: str, radius: dict[str, float] | None = None) -> DataFrame:
    """system_a defects on active dies in scan order, with a radius that suits the test tables, or ``radius`` by substrate ({}: the profile's)."""
    order = Window.partitionBy("panel_id").orderBy("defect_key", "defect_type", "confidence_score", "created_at")
    eps = F.when(F.col("substrate_type") == "wafer", 10.0).otherwise(130.0)
    found = fab.active_defects(spark, sf_dir)
    if radius is not None:
        found, eps = fab.with_profile(found), F.col("match_mm")
        for substrate, own in radius.items():
            eps = F.when(F.col("substrate_type") == substrate, float(own)).otherwise(eps)
    return found.select("panel_id", F.row_number().over(order).alias("idx"), "x", "y", eps.alias("eps"), "component_row", "component_col")


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(cut(panel_points(spark, sf_dir).select("panel_id", "idx", "x", "y", "eps")), 3)


def classify(labels: DataFrame) -> DataFrame:
    """Clusters, noise and class of each panel: excursion when one cluster holds over 30 % of all points."""
    sizes = labels.groupBy("panel_id", "label").agg(F.count("*").alias("n"))
    agg = sizes.groupBy("panel_id").agg(F.count(F.when(F.col("label") >= 0, 1)).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("n"))), F.lit(0)).alias("n_noise"), F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("n"))), F.lit(0)).alias("largest"), F.sum("n").alias("points"))
    label = F.when(F.col("n_clusters") == 0, "random").when(F.col("largest") / F.col("points") > 0.30, "excursion").when(F.col("n_clusters") >= 2, "systematic").otherwise("random")
    return agg.withColumn("pattern", label)


def dbscan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(dbscan_labels(spark, sf_dir))


def dbscan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all panels at the radius of their profile."""
    points = cut(panel_points(spark, sf_dir, {}).select("panel_id", "idx", "x", "y", "eps"))
    return classify(dbscan(points, 3))


def die_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each die's clustered points and its dominant cluster: the most frequent, then smallest label; -1 if all are noise."""
    points, key = cut(panel_points(spark, sf_dir)), ["panel_id", "component_row", "component_col"]
    place = points.select("panel_id", "idx", "component_row", "component_col")
    n = dbscan(points.select("panel_id", "idx", "x", "y", "eps"), 3).join(place, ["panel_id", "idx"]).groupBy(*key, "label").agg(F.count("*").alias("n"))
    top = F.min(F.when(F.col("label") >= 0, F.struct((-F.col("n")).alias("less"), "label")))
    return n.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("label") >= 0, F.col("n"))), F.lit(0)).alias("clustered"), F.coalesce(top["label"], F.lit(-1)).alias("cluster_label"))


QUERIES = {"dbscan_labels": dbscan_labels, "dbscan_summary": dbscan_summary, "dbscan_profile": dbscan_profile, "die_clusters": die_clusters}

#: CTEs that follow PREFIX: points, neighbours, labels (lb), classes (cls) and dies (dc).
CLUSTERS = """, pt AS (SELECT panel_id, component_row, component_col, row_number() OVER (PARTITION BY panel_id ORDER BY defect_key, defect_type, confidence_score, created_at) AS idx, x, y, CASE WHEN substrate_type = 'wafer' THEN 10.0 ELSE 130.0 END::DOUBLE AS eps FROM active_a),
nb AS (SELECT a.panel_id, a.idx AS a, b.idx AS b FROM pt a JOIN pt b ON a.panel_id = b.panel_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= a.eps * a.eps),
core AS (SELECT panel_id, a AS idx FROM nb GROUP BY ALL HAVING count(*) >= 3),
cc AS (SELECT nb.* FROM nb JOIN core c ON c.panel_id = nb.panel_id AND c.idx = a JOIN core d ON d.panel_id = nb.panel_id AND d.idx = b),
reach(panel_id, a, b) AS (SELECT panel_id, a, b FROM cc UNION SELECT r.panel_id, r.a, c.b FROM reach r JOIN cc c ON c.panel_id = r.panel_id AND c.a = r.b),
root AS (SELECT panel_id, a AS idx, min(b) AS root FROM reach GROUP BY ALL),
lab AS (SELECT panel_id, idx, (dense_rank() OVER (PARTITION BY panel_id ORDER BY root) - 1)::INT AS label FROM root),
bd AS (SELECT nb.panel_id, b AS idx, min(label) AS label FROM nb JOIN lab ON lab.panel_id = nb.panel_id AND lab.idx = a GROUP BY ALL),
lb AS (SELECT p.panel_id, p.idx, coalesce(l.label, b.label, -1) AS label FROM pt p LEFT JOIN lab l USING (panel_id, idx) LEFT JOIN bd b USING (panel_id, idx)),
cs AS (SELECT panel_id, label, count(*) AS n FROM lb GROUP BY ALL),
cg AS (SELECT panel_id, count(*) FILTER (label >= 0) AS n_clusters, coalesce(sum(n) FILTER (label < 0), 0)::BIGINT AS n_noise, coalesce(max(n) FILTER (label >= 0), 0) AS largest, sum(n)::BIGINT AS points FROM cs GROUP BY 1),
cls AS (SELECT *, CASE WHEN n_clusters = 0 THEN 'random' WHEN largest / points > 0.3 THEN 'excursion' WHEN n_clusters >= 2 THEN 'systematic' ELSE 'random' END AS pattern FROM cg),
dn AS (SELECT panel_id, component_row, component_col, label, count(*) AS n FROM lb JOIN pt USING (panel_id, idx) GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY panel_id, component_row, component_col ORDER BY label < 0, n DESC, label) AS k FROM dn),
dc AS (SELECT panel_id, component_row, component_col, coalesce(sum(n) FILTER (label >= 0), 0)::BIGINT AS clustered, max(label) FILTER (k = 1) AS cluster_label FROM dr GROUP BY ALL)
"""
ORACLE_SQL = {
    "dbscan_labels": PREFIX + CLUSTERS + "SELECT * FROM lb",
    "dbscan_summary": PREFIX + CLUSTERS + "SELECT * FROM cls",
    "dbscan_profile": PREFIX + CLUSTERS.replace("THEN 10.0 ELSE 130.0 END", "THEN 2.0 ELSE 15.0 END") + "SELECT * FROM cls",
    "die_clusters": PREFIX + CLUSTERS + "SELECT * FROM dc",
}
