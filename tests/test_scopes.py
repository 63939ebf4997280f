"""Scoped repeats, stored models and lots without panels, on small frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lotwise.operators import clustering, correlation, learning
from lotwise.sources.commits import Store

SF = "/root/testdata/sf0.001"


def test_repeats_of_a_scope(spark):
    panels = spark.createDataFrame([("L1", f"P{k}") for k in range(4)] + [("L2", "Q")] + [("L3", "R1"), ("L3", "R2")], "lot string, panel_id string")
    rows = [("L1", f"P{k}", 0, 0, "pit") for k in range(4)] * 3 + [("L1", "P0", 1, 1, "void"), ("L1", "P0", 1, 1, "pit"), ("L2", "Q", 0, 0, "pit")]
    found = spark.createDataFrame(rows, "lot string, panel_id string, component_row int, component_col int, defect_type string")
    got = {r.lot: (r.panels, r.locations, r.systematic, r.pattern) for r in correlation.repeats_of(found, panels, ["lot"]).collect()}
    assert got == {"L1": (4, 2, 1, "reticle_suspect"), "L2": (1, 0, 0, "insufficient_data"), "L3": (2, 0, 0, "clean")}
    assert {r.pattern for r in correlation.repeats_of(found.withColumn("defect_type", F.concat("defect_type", "panel_id")), panels.filter("lot = 'L1'"), ["lot"]).collect()} == {"tool_suspect"}


def test_stored_models(spark, tmp_path):
    store, names = Store(spark, f"file://{tmp_path}/models"), ["a", "b"]
    with pytest.raises(LookupError):
        learning.stored_model(store)
    zero = [[0.0] * len(learning.FEATURES)] * 2
    one = [zero[0], [1.0] + zero[0][1:]]
    learning.store_model(store, "new", datetime(2024, 5, 1), names, one, 0.9)
    learning.store_model(store, "old", datetime(2023, 5, 1), names, zero)
    rows = spark.createDataFrame([tuple([1.0] + [0.0] * (len(learning.FEATURES) - 1))], ", ".join(f"{f} double" for f in learning.FEATURES))
    latest, old = learning.predict_stored(rows, store).first(), learning.predict_stored(rows, store, "old").first()
    assert (latest.model_id, latest.predicted, old.predicted, old.probability) == ("new", "b", "a", 0.5) and latest.probability == round(1 / (1 + 2.718281828459045**-1), 6)
    with pytest.raises(LookupError):
        learning.stored_model(store, "other")


def test_the_plan_grows_with_the_classes(spark):
    rows = spark.createDataFrame([tuple([1.0] * len(learning.FEATURES))], ", ".join(f"{f} double" for f in learning.FEATURES))
    size = lambda n: len(learning.predict(rows, learning.example_weights(["x"] * n), [f"c{k}" for k in range(n)])._jdf.queryExecution().optimizedPlan().toString())
    assert size(40) < 6 * size(10)


def test_default_radius_is_the_profiles(spark):
    assert {r.eps for r in clustering.panel_points(spark, SF, {}).select("eps").distinct().collect()} == {2.0, 15.0}
    assert {r.eps for r in clustering.panel_points(spark, SF, {"wafer": 7}).select("eps").distinct().collect()} == {7.0, 15.0}
