"""Interval and as-of joins against plain loops, with ties, gaps, nulls, long intervals and a hot key; the join of two streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lotwise.operators import time_joins as tj


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    points = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(-500, 3000), k) for k in range(900)] + [("a", None, 900), ("alone", 5, 901), ("a", 100, 902), ("a", 100, 902)]
    intervals = []
    for k in range(300):
        start = rng.randrange(-500, 3000)
        intervals.append(("hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c", None]), start, start + rng.choice([0, 1, 7, 60, 5000, -3]), k))
    return points, intervals + [("a", None, 5, 300), ("a", 100, 101, 301), ("a", -(10**15), 10**15, 302)]


def frames(spark, rows):
    points, intervals = rows
    return spark.createDataFrame(points, "k string, t long, p int").repartition(5), spark.createDataFrame(intervals, "k string, start long, end long, i int").repartition(3)


@pytest.mark.parametrize("bucket", [1, 16, 10_000])
def test_interval_join(spark, rows, bucket):
    points, intervals = frames(spark, rows)
    found = sorted((r.p, r.i) for r in tj.interval_join(points, intervals, "k", bucket=bucket).collect())
    want = sorted((p, i) for k, t, p in rows[0] for own, start, end, i in rows[1] if None not in (k, t, start) and own == k and start <= t < end)
    assert found == want and len(want) > 1000
    assert tj.interval_join(points, intervals.limit(0), "k").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        tj.interval_join(points.withColumn("i", F.lit(1)), intervals, "k")


@pytest.mark.parametrize("tolerance", [None, 30])
def test_asof_join(spark, rows, tolerance):
    points, intervals = frames(spark, rows)
    log = intervals.select("k", F.col("start").alias("t"), F.col("i").alias("n"))
    found = sorted(((r.k, r.t, r.p), r.found and (r.found.t, r.found.n)) for r in tj.asof_join(points, log, "k", tie="n", tolerance=tolerance).fillna("", ["k"]).fillna(-9999, ["t"]).collect())
    want = []
    for k, t, p in rows[0]:
        before = [(start, i) for own, start, _, i in rows[1] if k is not None and t is not None and own == k and start is not None and start <= t]
        best = max(before, default=None)
        want.append(((k or "", -9999 if t is None else t, p), best if best and (tolerance is None or t - best[0] <= tolerance) else None))
    assert found == sorted(want, key=lambda x: (x[0], x[1] is not None, x[1]))
    assert tj.asof_join(points, log.limit(0), "k").filter("found is not null").count() == 0
    assert tj.asof_join(points.limit(0), log, "k").count() == 0


def test_two_streams_equal_the_tables(spark, tmp_path):
    base, rng = datetime(2024, 1, 1), random.Random(2)
    at = lambda minute: base + timedelta(minutes=minute)
    points = [(rng.randrange(3), at(m + rng.random()), m) for m in range(0, 600, 2)]
    runs = [(rng.randrange(3), at(m), at(m + rng.randrange(1, 150)), m) for m in range(0, 600, 7)]
    for k in range(3):  # three files of each side, in the order of time
        spark.createDataFrame(points[k * 100 : (k + 1) * 100], "tool int, t timestamp, p int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/points")
        spark.createDataFrame(runs[k * 29 : (k + 1) * 29], "tool int, start timestamp, end timestamp, r int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs")
    read = lambda name, kinds: spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    kinds = ("tool int, t timestamp, p int", "tool int, start timestamp, end timestamp, r int")

    def run():
        joined = tj.streamed_interval_join(read("points", kinds[0]), read("runs", kinds[1]), "tool").select("p", "r")
        query = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    query = run()
    want = tj.streamed_interval_join(spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/runs"), "tool").select("p", "r")
    plain = sorted((p, r) for tool, t, p in points for own, start, end, r in runs if tool == own and start <= t < end)
    assert sorted(map(tuple, want.collect())) == plain
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == plain and tj.dropped_rows(query) == 0
    spark.createDataFrame([(0, at(1), 9001), (1, at(599), 9002)], "tool int, t timestamp, p int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/points")
    late = run()  # goes on from its checkpoint: the row of minute 1 is long past the watermark
    assert tj.dropped_rows(late) == 1
    assert 9001 not in {r.p for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_interval_counts_are_those_of_the_pairs(spark, rows):
    """Counts without pairs: nulls, empty and repeated intervals, repeated points, ties of starts, ends and points."""
    points, intervals = frames(spark, rows)
    kinded = intervals.withColumn("kind", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit(None).cast("string")), (F.col("i") % 3 + 1).cast("int")))
    found, kinds = tj.interval_counts(points, kinded, "k", "kind")
    assert kinds == [None, "x", "y"]
    got = sorted(str((r.p, r.t, kind, r[f"n_{i}"])) for r in found.collect() for i, kind in enumerate(kinds) if r[f"n_{i}"])
    want = {}
    for k, t, p in set(rows[0]):
        for key, start, end, i in rows[1]:
            if None not in (k, t, key, start, end) and k == key and start <= t < end:
                at = (p, t, ["x", "y", None][i % 3])
                want[at] = want.get(at, 0) + 1
    repeats = {(p, t): rows[0].count((k, t, p)) for k, t, p in rows[0]}
    assert got == sorted(str((*at, n)) for at, n in want.items() for _ in range(repeats[at[:2]]))
    none, kinds = tj.interval_counts(points, kinded.limit(0), "k", "kind")
    assert none.count() == 0 and kinds == []


def test_run_defects_makes_no_pairs(spark):
    """One pass over points and runs: rows of no join grow with their product."""
    plan = tj.run_defects(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_level" not in plan
