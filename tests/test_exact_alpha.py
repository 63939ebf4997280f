"""Clustering parameters where variance and mean of the counts are equal, in any order of the rows; dies of active defects without the component table."""

import random

from pyspark.sql import functions as F

from lotwise.functions import sql_functions
from lotwise.operators.yields import yields_of_dies
from lotwise.plans import fab_view as fab

SF = "/root/testdata/sf0.001"


def tied(k):
    """Counts of 25 dies with variance = mean: 25 q = s (s + 24)."""
    rng = random.Random(k)
    while True:
        counts = [rng.randrange(7) for _ in range(25)]
        s, q = sum(counts), sum(c * c for c in counts)
        if s and 25 * q == s * (s + 24):
            return counts


def test_equal_variance_and_mean_are_not_over_dispersed(spark):
    rows = [(f"P{k}", "wafer", i, n, True, 0.5 * n) for k in range(60) for i, n in enumerate(tied(k))]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        dies = spark.createDataFrame(rows, "panel_id string, substrate_type string, component_row int, n long, active boolean, fraction double").repartition(7)
        assert {r.alpha for r in yields_of_dies(dies).collect()} == {50.0}
    sql_functions.register(spark)
    sums = dies.groupBy("panel_id").agg(F.count("n").alias("d"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    assert {r[0] for r in sums.select(F.expr("counted_alpha(d, s, q)")).collect()} == {50.0}
    got = spark.sql("SELECT counted_alpha(4, 8, 40), counted_alpha(3, 8, 40), counted_alpha(4, 0, 0), moments_alpha(4, 2D, 8D), counted_alpha(1000000000, 3000000000, 900000000000)").first()
    assert got[:4] == (got[3], 1.0, 1.0, 0.6667) and 0.05 <= got[4] < 1


def test_active_defects_meet_no_components(spark):
    """A hundred dies a panel are never joined (Spark broadcast them all), and the rows are those of the join."""
    found = fab.active_defects(spark, SF, None)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    place = ["panel_id", "component_row", "component_col"]
    want = fab.defects(spark, SF).join(fab.components(spark, SF).filter("active").select(*place, "region_id"), place)
    columns = ["defect_key", "region_id", *place, "x", "y"]
    assert found.select(columns).exceptAll(want.select(columns)).isEmpty() and found.count() == want.count()


def test_orphans_and_suite_broadcast_no_components(spark):
    from lotwise.operators import quality_checks as qc

    for query in (qc.orphan_defects, qc.validation_suite):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange HashedRelationBroadcastMode(List(input[0, string, true], input[1, int" not in plan
