"""Defect classification, splits, cross-system matching and yield simulation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import yield_models as ym
from lotwise.functions.lineage import cut, scratch
from lotwise.operators.listing import where_equal
from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX
from lotwise.sources.commits import Store

REGIONS = ["zone_center", "zone_mid", "zone_edge", "region_NW", "region_NE", "region_SW", "region_SE"]
#: Fixed order.
FEATURES = ["bias", "size", "confidence", "x_norm", "y_norm", "row_norm", "col_norm", *REGIONS, "is_wafer"]


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen features of every system_a defect on an active die.

    Positions are over the panel's columns and rows and clamped to +-10; seven indicators tell the region.
    """
    clamp = lambda c: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), c))
    size = fab.panels(spark, sf_dir).select("panel_id", F.greatest("rows", F.lit(1)).cast("double").alias("n_rows"), F.greatest("cols", F.lit(1)).cast("double").alias("n_cols"))
    return fab.active_defects(spark, sf_dir).join(size, "panel_id").select(
        "panel_id", "defect_key", "defect_type", F.lit(1.0).alias("bias"), "size", F.col("confidence_score").alias("confidence"), clamp(F.col("x") / F.col("n_cols")).alias("x_norm"), clamp(F.col("y") / F.col("n_rows")).alias("y_norm"),
        (F.col("component_row") / F.col("n_rows")).alias("row_norm"), (F.col("component_col") / F.col("n_cols")).alias("col_norm"), *((F.col("region_id") == r).cast("double").alias(r) for r in REGIONS),
        (F.col("substrate_type") == "wafer").cast("double").alias("is_wafer"),
    )


def predict(rows: DataFrame, weights: list[list[float]], classes: list[str]) -> DataFrame:
    """Adds ``predicted``, its ``probability`` and the array ``class_probs`` of a softmax model; of equal scores the first class.

    Probabilities have six digits.
    """
    scores = F.array(*(sum((F.col(f) * w for f, w in zip(FEATURES, line, strict=True)), F.lit(0.0)) for line in weights))
    # Each step is bound to a column of its own, so the plan grows with the classes, not with their square.
    scored = rows.withColumn("_scores", scores).withColumn("_top", F.array_max("_scores")).withColumn("_exp", F.transform("_scores", lambda s: F.exp(s - F.col("_top"))))
    summed = scored.withColumn("_total", F.aggregate("_exp", F.lit(0.0), lambda acc, e: acc + e))
    names = F.array(*map(F.lit, classes))
    return summed.withColumns({
        "predicted": F.get(names, (F.array_position("_scores", F.col("_top")) - 1).cast("int")), "probability": F.round(1 / F.col("_total"), 6),
        "class_probs": F.transform("_exp", lambda e: F.round(e / F.col("_total"), 6)),
    }).drop("_scores", "_top", "_exp", "_total")


MODEL = "model_id string, trained_at timestamp, classes array<string>, weights array<array<double>>, accuracy double"


def store_model(store: Store, model_id: str, trained_at: datetime, classes: list[str], weights: list[list[float]], accuracy: float | None = None) -> int:
    """Appends a trained model to the store's table ``models``; returns the store's version."""
    return store.transact(lambda _: {"models": store.spark.createDataFrame([(model_id, trained_at, classes, weights, accuracy)], MODEL)})


def stored_model(store: Store, model_id: str | None = None):
    """The row of a stored model, by default of the latest (of equal times the greatest id)."""
    found = where_equal(store.read("models", like=MODEL), model_id=model_id).orderBy(F.desc("trained_at"), F.desc("model_id")).first()
    if found is None:
        raise LookupError("no stored model" if model_id is None else f"no model {model_id!r}")
    return found


def predict_stored(rows: DataFrame, store: Store, model_id: str | None = None) -> DataFrame:
    """:func:`predict` by a stored model, by default the latest."""
    model = stored_model(store, model_id)
    return predict(rows, model.weights, model.classes).withColumn("model_id", F.lit(model.model_id))


def latest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by the latest of two stored models: one of zero weights, and one of a round of training."""
    names, rows, store = _classes(spark, sf_dir), cut(feature_vectors(spark, sf_dir)), Store(spark, scratch(spark, "models"))
    store_model(store, "trained", datetime(2024, 2, 1), names, train_softmax(rows, names, rate=0.5, rounds=1))
    store_model(store, "zero", datetime(2024, 1, 1), names, [[0.0] * len(FEATURES) for _ in names])
    found = predict_stored(rows, store)
    return found.groupBy("panel_id", "model_id", "predicted").agg(F.count("*").alias("n"), F.count(F.when(F.col("predicted") == F.col("defect_type"), 1)).alias("correct"), F.round(F.avg("probability"), 5).alias("probability"))


def example_weights(classes: list[str]) -> list[list[float]]:
    """Fixed weights by a rule, for exact comparison with an oracle."""
    return [[((i * 7 + j * 3) % 11 - 5) / 8.0 for j in range(len(FEATURES))] for i in range(len(classes))]


def _classes(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r[0] for r in fab.table(spark, sf_dir, "part").select("p_type").distinct().orderBy("p_type").collect()]  # the whole taxonomy


def logit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _classes(spark, sf_dir)
    found = predict(feature_vectors(spark, sf_dir), example_weights(names), names)
    probs = F.array_join(F.transform("class_probs", lambda p: F.format_number(p, 6)), ",")
    return found.select("panel_id", "defect_key", "defect_type", "predicted", "probability", probs.alias("class_probs"), (F.col("predicted") == F.col("defect_type")).alias("correct"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and support per class and the accuracy, from one grouping of (true, predicted) pairs."""
    return evaluate(logit_predict(spark, sf_dir))


def evaluate(predicted: DataFrame) -> DataFrame:
    """Per class: support, guessed, tp, precision, recall; and the accuracy over all classes."""
    pairs = predicted.groupBy("defect_type", "predicted").agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("defect_type").alias("class"), F.lit(1).alias("true"), F.lit(0).alias("guess")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("true"), F.lit(1).alias("guess")))).alias("s"), "n", (F.col("defect_type") == F.col("predicted")).alias("hit"))
    agg = sides.groupBy(F.col("s.class").alias("class")).agg(F.sum(F.col("s.true") * F.col("n")).alias("support"), F.sum(F.col("s.guess") * F.col("n")).alias("guessed"), F.sum(F.when(F.col("hit"), F.col("s.true") * F.col("n")).otherwise(0)).alias("tp"))
    every = Window.partitionBy()  # a row per class
    accuracy = F.coalesce(F.try_divide(F.sum("tp").over(every), F.sum("support").over(every)), F.lit(0.0))
    return agg.select("class", "support", "guessed", "tp", F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"), accuracy.alias("accuracy"))


def softmax_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of ten rounds of training, against that of the first weights (all zero: the first class)."""
    names, rows = _classes(spark, sf_dir), feature_vectors(spark, sf_dir)
    share = lambda weights: F.avg((F.col("predicted") == F.col("defect_type")).cast("double"))  # noqa: E731, ARG005
    both = [("zero", [[0.0] * len(FEATURES) for _ in names]), ("trained", train_softmax(rows, names, rate=0.02, rounds=10))]
    scored = [predict(rows, w, names).agg(F.lit(k).alias("model"), F.count("*").alias("n"), share(w).alias("accuracy")) for k, w in both]
    return scored[0].unionByName(scored[1])


def train_softmax(rows: DataFrame, classes: list[str], rate: float = 0.05, l2: float = 0.01, rounds: int = 400, stop: float = 1e-5) -> list[list[float]]:
    """Full-batch gradient descent from zero weights; each round is one distributed sum of gradients.

    The bias is exempt from the penalty. Needs ten rows and two classes.
    """
    if len(classes) < 2 or rows.limit(10).count() < 10:
        raise ValueError("training needs ten rows and two classes")
    features = FEATURES
    kept = cut(rows.select("defect_type", *features))
    weights, last = np.zeros((len(classes), len(features))), math.inf
    shape = weights.shape

    for _ in range(rounds):
        current = weights.copy()

        def gradient(frames, current=current):
            total, loss, n = np.zeros(shape), 0.0, 0
            for frame in frames:
                x = frame[features].to_numpy(np.float64)
                y = frame["defect_type"].map({c: k for k, c in enumerate(classes)}).to_numpy()
                z = x @ current.T
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                loss -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum()
                p[np.arange(len(y)), y] -= 1
                total, n = total + p.T @ x, n + len(y)
            yield pd.DataFrame([{"g": total.ravel().tolist(), "loss": loss, "n": n}])

        parts = kept.mapInPandas(gradient, "g array<double>, loss double, n long").toPandas()  # a row per task
        n = parts["n"].sum()
        penalty = current.copy()
        penalty[:, 0] = 0
        weights = current - rate * (np.sum(parts["g"].tolist(), axis=0).reshape(shape) / n + l2 * penalty / n)
        loss = parts["loss"].sum() / n
        if abs(last - loss) < stop:
            break
        last = loss
    return weights.tolist()


def split_by_type(rows: DataFrame, key: list[str], type_column: str = "defect_type", seed: int = 42, train: float = 0.8, val: float = 0.1, per_panel: int | None = None) -> DataFrame:
    """Adds ``split``: of each type's n rows in hash order, floor(train n) train, the next floor(val n) val, the rest test.

    ``per_panel`` keeps that many rows of each panel, the first in key order. The hash of the key and seed orders the rows;
    equal keys follow one another. Ranks come from counts: rows are dealt to slices of the hash's range,
    each slice is ranked by itself, and the slices' counts before it are added, so no type fills a task.
    """
    if per_panel is not None:
        w = Window.partitionBy("panel_id").orderBy(*key)
        rows = rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_panel).drop("_k")
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key))))
    hashed = hashed.withColumn("_slice", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = hashed.groupBy(type_column, "_slice").agg(F.count("*").alias("_c"))
    # At most 4,096 rows per type: running sums over slices.
    by_slice = Window.partitionBy(type_column).orderBy("_slice")
    before = counts.select(
        type_column, "_slice", (F.sum("_c").over(by_slice) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(type_column)).alias("_n")
    )
    placed = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(type_column, "_slice").orderBy("_h", *key))).join(F.broadcast(before), [type_column, "_slice"])
    rank, n_train, n_val = F.col("_before") + F.col("_r"), F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(val))
    split = F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
    return placed.withColumn("split", split).drop("_h", "_slice", "_before", "_n", "_r")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of at most 500 a panel, split by type."""
    rows = fab.defects(spark, sf_dir).select("panel_id", "defect_type", "defect_key")
    return split_by_type(rows, ["defect_key"], per_panel=500).groupBy("panel_id", "defect_type", "split").agg(F.count("*").alias("n"), F.max("defect_key").alias("last_key"))


#: Pairs of defects that are compared at once.
PAIRS = 1 << 20


def match_dies(frame: pd.DataFrame, die: list[str]) -> pd.DataFrame:
    """Rows of :func:`match_systems` for dies that follow one another in ``frame``: each system_a row in turn takes the nearest free system_b row of its die (the first of equals) within its limit.

    Distances are of whole arrays over all dies; only pairs within the limit are looked at one by one.
    """
    number = np.cumsum((frame[die] != frame[die].shift()).any(axis=1).to_numpy())
    a, b = (np.flatnonzero((frame["source_system"] == system).to_numpy()) for system in ("system_a", "system_b"))
    first, last = (np.searchsorted(number[b], number[a], side) for side in ("left", "right"))
    x, y, limit = (frame[c].to_numpy(np.float64) for c in ("x", "y", "match_mm"))
    upto = np.cumsum(last - first)
    free, rows, begin = np.ones(len(b), bool), [], 0
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
        n = (last - first)[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
        d = np.hypot(x[b[j]] - x[a[i]], y[b[j]] - y[a[i]])
        near = np.flatnonzero(d <= limit[a[i]])
        near = near[np.lexsort((j[near], d[near], i[near]))]
        done = -1
        for p, q, distance in zip(i[near].tolist(), j[near].tolist(), d[near].tolist(), strict=True):
            if p != done and free[q]:
                free[q], done = False, p
                rows.append((a[p], b[q], distance))
        begin = end
    left, right, distance = zip(*rows, strict=True) if rows else ((), (), ())
    keys, at = frame["defect_key"].to_numpy(object), np.array(left, int)
    return pd.DataFrame({"panel_id": frame["panel_id"].to_numpy(object)[at], "a_key": keys[at], "b_key": keys[np.array(right, int)], "distance": np.array(distance, float)})


def match_systems(found: DataFrame) -> DataFrame:
    """panel_id, a_key, b_key, distance of system_a defects matched with system_b ones, die by die.

    A die is the unit within which order counts, so one die is all that a task holds; defects go in key order.
    """

    die = ["panel_id", "component_row", "component_col"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the die that the batches so far end with
        for frame in frames:
            rest = pd.concat([*held, frame]) if held else frame
            last = (rest[die] == rest[die].iloc[-1]).all(axis=1)
            yield match_dies(rest[~last], die)
            held = [rest[last]]
        if held:
            yield match_dies(held[0], die)

    # Dies follow one another in a task, so a call per die and a group per panel are both avoided.
    dealt = found.repartition(*die).sortWithinPartitions(*die, "defect_key", "x", "y")
    return dealt.mapInPandas(run, "panel_id string, a_key string, b_key string, distance double")


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fab.with_profile(fab.defects(spark, sf_dir))
    return match_systems(found.select("panel_id", "component_row", "component_col", "source_system", "defect_key", "x", "y", "match_mm"))


def learning_curve(spark: SparkSession, sf_dir: str, start: float = 0.4, ceiling: float = 0.9, rate: float = 0.08, months: int = 24) -> DataFrame:
    """Yield by month for three models: linear, exponential (the gap closes by the rate) and falling density."""
    m = spark.range(months + 1).select(F.col("id").cast("int").alias("month"))
    linear = F.least(F.lit(ceiling), F.lit(start) + rate * (ceiling - start) * F.col("month"))
    exponential = F.lit(ceiling) - (ceiling - start) * F.pow(F.lit(1 - rate), F.col("month").cast("double"))
    falling = F.least(F.lit(ceiling), F.exp(F.lit(math.log(start)) * F.pow(F.lit(1 - rate), F.col("month").cast("double"))))
    return m.select("month", linear.alias("linear"), exponential.alias("exponential"), falling.alias("d0_learning"))


def dies_per_wafer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross dies on a wafer for die areas taken from part sizes."""
    p = fab.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("area")).distinct()
    return p.select("area", ym.dies_per_wafer(F.lit(300.0), F.col("area")).alias("dies"))


def component_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and edge exclusion of the dies of every panel."""
    return fab.components(spark, sf_dir)


def monte_carlo(spark: SparkSession, runs: int, dies: int, density_cm2: float, area_mm2: float, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """run, yield: simulated wafers of ``dies`` dies; a die without a defect passes. Seeded by run, so retries agree."""
    mean = density_cm2 * area_mm2 * fraction / 100

    def simulate(frames):
        for frame in frames:
            ok = [float((np.random.default_rng([seed, r]).poisson(mean, dies) == 0).mean()) for r in frame["id"]]
            yield pd.DataFrame({"run": frame["id"], "yield": ok})

    return spark.range(runs).mapInPandas(simulate, "run long, yield double")


def monte_carlo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, extremes and percentiles of the default simulation."""
    y = F.col("yield")
    runs = monte_carlo(spark, 2000, 500, 0.5, 100.0)
    return runs.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"), F.percentile(y, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).select(
        "mean", "std", "min", "max", F.get("p", F.lit(0)).alias("p10"), F.get("p", F.lit(1)).alias("p50"), F.get("p", F.lit(2)).alias("p90")
    )


QUERIES = {f.__name__: f for f in (feature_vectors, logit_predict, confusion, softmax_model, latest_predictions, stratified_split, greedy_match, dies_per_wafer, component_grid)}

_FV = PREFIX + """, fv AS (SELECT panel_id, defect_key, defect_type, 1.0::DOUBLE AS bias, size, confidence_score AS confidence, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, x / cols)) AS x_norm, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, y / rows)) AS y_norm,
  component_row / rows AS row_norm, component_col / cols AS col_norm, """ + ", ".join(f"(region_id = '{r}')::INT::DOUBLE AS {r}" for r in REGIONS) + ", (substrate_type = 'wafer')::INT::DOUBLE AS is_wafer FROM active_a JOIN (SELECT panel_id, rows, cols FROM panels) USING (panel_id))"
_SCORE = "0.0::DOUBLE + " + " + ".join(f"{f} * (((i * 7 + {j * 3}) % 11 - 5) / 8.0::DOUBLE)" for j, f in enumerate(FEATURES))
_LP = _FV + f""", cl AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_type FROM part)), fr AS (SELECT *, row_number() OVER () AS rid FROM fv),
sc AS (SELECT rid, panel_id, defect_key, defect_type, p_type, i, {_SCORE} AS s FROM fr CROSS JOIN cl), ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY rid)) AS e FROM sc), pr AS (SELECT *, round(e / sum(e) OVER (PARTITION BY rid), 6) AS p FROM ex),
lp AS (SELECT panel_id, defect_key, defect_type, first(p_type ORDER BY s DESC, i) AS predicted, max(p) AS probability, string_agg(printf('%.6f', p), ',' ORDER BY i) AS class_probs, first(p_type ORDER BY s DESC, i) = defect_type AS correct FROM pr GROUP BY rid, panel_id, defect_key, defect_type)"""
ORACLE_SQL = {
    "feature_vectors": _FV + " SELECT * FROM fv",
    "logit_predict": _LP + " SELECT * FROM lp",
    "confusion": _LP + """, c AS (SELECT defect_type AS class, count(*) AS support, count(*) FILTER (defect_type = predicted) AS tp FROM lp GROUP BY 1), g AS (SELECT predicted AS class, count(*) AS guessed FROM lp GROUP BY 1)
SELECT class, coalesce(support, 0) AS support, coalesce(guessed, 0) AS guessed, coalesce(tp, 0) AS tp, coalesce(tp / nullif(guessed, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
  (SELECT avg(correct::INT) FROM lp) AS accuracy FROM c FULL JOIN g USING (class)""",
    "latest_predictions": _FV + ", cl AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT p_type FROM part)), fr AS (SELECT *, row_number() OVER () AS rid FROM fv), wt AS (SELECT p_type, i, "
    + ", ".join(f"0.5 * (sum({f}) FILTER (defect_type = p_type) - sum({f}) / any_value(k)) / count(*) AS w_{f}" for f in FEATURES)
    + " FROM fv CROSS JOIN cl GROUP BY p_type, i), sc AS (SELECT rid, panel_id, defect_type, p_type, i, 0.0::DOUBLE + " + " + ".join(f"{f} * coalesce(w_{f}, 0)" for f in FEATURES)
    + """ AS s FROM fr CROSS JOIN wt), ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY rid)) AS e FROM sc), pr AS (SELECT *, round(e / sum(e) OVER (PARTITION BY rid), 6) AS p FROM ex),
lp AS (SELECT panel_id, defect_type, first(p_type ORDER BY s DESC, i) AS predicted, max(p) AS probability FROM pr GROUP BY rid, panel_id, defect_type)
SELECT panel_id, 'trained' AS model_id, predicted, count(*) AS n, count(*) FILTER (predicted = defect_type) AS correct, round(avg(probability), 5) AS probability FROM lp GROUP BY ALL""",
    "dies_per_wafer": "SELECT DISTINCT p_size::DOUBLE AS area, greatest(1, trunc(pi() * 150 * 150 / p_size - pi() * 300 / sqrt(2 * p_size))::INT) AS dies FROM part",
    "component_grid": PREFIX + "SELECT * FROM components",
    "stratified_split": PREFIX + """, r AS (SELECT panel_id, defect_type, defect_key, row_number() OVER (PARTITION BY panel_id ORDER BY defect_key) AS k FROM defects),
f AS (SELECT panel_id, defect_type, defect_key, row_number() OVER (PARTITION BY defect_type ORDER BY md5('42|' || defect_key), defect_key) AS k, count(*) OVER (PARTITION BY defect_type) AS n FROM r WHERE k <= 500)
SELECT panel_id, defect_type, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split, count(*) AS n, max(defect_key) AS last_key FROM f GROUP BY ALL""",
}
