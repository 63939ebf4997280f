"""Running totals, medians and control charts over groups of many ranges and chunks, against plain loops."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import ordered, spc


@pytest.fixture(scope="module")
def skewed(spark):
    """A group of most rows with one value of a third, small groups, a null group, null values."""
    rng = random.Random(3)
    rows = [("hot", 5.0 if rng.random() < 0.33 else rng.expovariate(1.0)) for _ in range(5000)]
    rows += [(None, float(k % 7)) for k in range(40)] + [("one", 2.5), ("two", 1.0), ("two", 4.0), ("hot", None), ("none", None)]
    return rows, spark.createDataFrame([(g, v, k) for k, (g, v) in enumerate(rows)], "g string, v double, k long").repartition(7)


def test_medians(skewed):
    rows, frame = skewed
    want = {g: statistics.median([v for h, v in rows if h == g and v is not None]) for g in {g for g, v in rows if v is not None}}
    assert {r.g: r.m for r in ordered.medians(frame, "g", "v", "m").collect()} == want


def test_numbers_and_totals(skewed):
    rows, frame = skewed
    order = {}
    for g, k in sorted(((g, -k) for k, (g, _) in enumerate(rows)), key=lambda t: (t[0] or "", t[1])):
        order[-k] = sum(1 for _ in [0]) + order.get(("last", g), 0)
        order[("last", g)] = order[-k]
    found = ordered.numbered(frame.withColumn("back", -F.col("k")), "g", ["back"]).collect()
    assert len(found) == len(rows) and all(r.seq == order[r.k] for r in found)
    plan = ordered.numbered(frame, "g", ["k"])._jdf.queryExecution().toString()
    assert "_range" in plan


def plain_charts(x, chart):
    mean, med = sum(x) / len(x), statistics.median(x)
    sigma = statistics.median([abs(v - med) for v in x]) * spc.MAD_SCALE
    e, hi, lo, out = mean, 0.0, 0.0, []
    for v in x:
        e = chart.weight * v + (1 - chart.weight) * e
        hi, lo = max(0.0, hi + v - mean - chart.slack * sigma), max(0.0, lo - v + mean - chart.slack * sigma)
        out.append((e, hi, lo))
    return mean, sigma, out


@pytest.mark.parametrize("weight", [0.0005, 0.2, 1.0])
@pytest.mark.parametrize("n,chunk", [(12_001, 4096), (700, 8)])  # of 8: three levels of chunks
def test_charts_of_one_long_series(spark, weight, n, chunk):
    rng = np.random.default_rng(1)
    series = {"a": (10 + rng.normal(size=n) + np.linspace(0, 1, n)).tolist(), "b": rng.exponential(size=9).tolist()}
    chart = spc.Chart(weight=weight)
    points = spark.createDataFrame([(s, k + 1, f"{s}{k}", v) for s, own in series.items() for k, v in enumerate(own)], "scope string, seq long, panel_id string, x double").repartition(5)
    found = spc.control_points(points, chart, chunk).collect()
    assert len(found) == n + 9
    for s, own in series.items():
        mean, sigma, want = plain_charts(own, chart)
        rows = sorted((r for r in found if r.scope == s), key=lambda r: r.seq)
        got = np.array([(r.ewma, r.cusum_hi, r.cusum_lo) for r in rows])
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9) and np.isclose(rows[0].sigma, sigma)
        above = [v > mean for v in own]
        for k, r in enumerate(rows):
            assert r.mr == (0.0 if k == 0 else abs(own[k] - own[k - 1]))
            assert r.we4 == (k >= 7 and (all(above[k - 7 : k + 1]) or not any(above[k - 7 : k + 1])))


def test_no_window_over_a_whole_scope(spark):
    points = spark.range(9000).select(F.lit("a").alias("scope"), (F.col("id") + 1).alias("seq"), F.col("id").cast("string").alias("panel_id"), F.rand(1).alias("x"))
    plan = spc.control_points(points)._jdf.queryExecution().optimizedPlan().toString()
    assert all("chunk" in line or "_range" in line or "_at" in line or "upper" in line for line in plan.splitlines() if " Window [" in line or line.strip("+- :").startswith("Window ["))
