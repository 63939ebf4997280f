"""SQL functions against the column functions, the table function, and sketches of runs against the data."""

import random

from pyspark.sql import functions as F

from lotwise.functions import sql_functions
from lotwise.functions import yield_models as ym
from lotwise.operators import run_sketches
from lotwise.plans import fab_view as fab
from lotwise.sources import klarf
from lotwise.sources.commits import Store


def test_functions_in_sql(spark):
    sql_functions.register(spark)
    rng = random.Random(1)
    rows = [(rng.random() * 3, rng.random() * 2, rng.random() * 12, rng.randrange(9), rng.choice(["wafer", "glass_panel"])) for _ in range(200)] + [(0.0, 0.0, 1.0, 0, "wafer"), (None, 1.0, 1.0, 5, None)]
    frame = spark.createDataFrame(rows, "a double, d double, al double, n long, s string")
    frame.createOrReplaceTempView("cases")
    want = frame.select(ym.poisson(F.col("a"), F.col("d")), ym.murphy(F.col("a"), F.col("d")), ym.negative_binomial(F.col("a"), F.col("d"), F.col("al")), ym.moments_alpha(F.col("n"), F.col("a"), F.col("al")), ym.critical_fraction(F.col("a"), F.col("d"), F.col("al")), ym.recommended_model(F.col("s"), F.col("al"), F.col("a"))).collect()
    found = spark.sql("SELECT yield_poisson(a, d), yield_murphy(a, d), yield_negbinom(a, d, al), moments_alpha(n, a, al), critical_fraction(a, d, al), recommended_model(s, al, a) FROM cases")
    assert list(map(tuple, found.collect())) == list(map(tuple, want))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_records_by_a_table_function(spark):
    sql_functions.register(spark)
    defects = klarf.typed_defects(spark, "/root/testdata/sf0.001")
    files = klarf.lot_files(defects, fab.panels(spark, "/root/testdata/sf0.001"), ["defect_key", "x", "y", "size", "confidence_score"])
    files.unionByName(spark.createDataFrame([("none", "f", None)], files.schema)).createOrReplaceTempView("files")
    found = spark.sql("SELECT r.* FROM files, LATERAL klarf2_records(content) r WHERE r.confidence >= 0 ")
    want = defects.filter("source_system = 'system_a'").groupBy("lot_id", "defect_type").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in found.groupBy("lot_id", "defect_type").agg(F.count("*")).collect()} == {tuple(r) for r in want}


def test_sketches_of_runs(spark, tmp_path):
    store, rng = Store(spark, f"file://{tmp_path}/s"), random.Random(4)
    runs = [[("k" if rng.random() < 0.9 else "m", rng.lognormvariate(0, 2), rng.randrange(20_000)) for _ in range(40_000)] for _ in range(5)]
    for k, own in enumerate(runs):
        frame = spark.createDataFrame(own + [("k", None, None), ("empty", None, 1)], "g string, v double, i int")
        for _ in range(2):  # the second time changes nothing
            run_sketches.append_run(store, f"r{k}", frame, ["g"], "v", "i")
    assert store.version() == 5
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = run_sketches.history_quantiles(store.read("sketches"), ["g"], shares).collect()
    for r in found:
        values = sorted(v for own in runs for g, v, _ in own if g == r.g)
        below, upto = sum(v < r.quantile for v in values) / len(values), sum(v <= r.quantile for v in values) / len(values)
        assert below - run_sketches.RANK_ERROR <= r.share <= upto + run_sketches.RANK_ERROR and r.n == len(values) and (r.low, r.high) == (values[0], values[-1])
        assert abs(r.distinct / len({i for own in runs for g, _, i in own if g == r.g}) - 1) <= run_sketches.DISTINCT_ERROR
    assert len(found) == 2 * len(shares)
    part = run_sketches.history_quantiles(store.read("sketches").filter("run_id in ('r1', 'r3')"), ["g"], [0.5]).filter("g = 'k'").first()
    assert part.n == sum(g == "k" for k in (1, 3) for g, _, _ in runs[k])
