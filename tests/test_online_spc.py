"""Charts of a stream against those of the table, over restarts, with late and null points."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lotwise.functions.lineage import cut
from lotwise.operators import spc
from lotwise.operators.ordered import numbered
from lotwise.streaming import online_spc as online


def test_stream_equals_table_after_a_restart(spark, tmp_path):
    rng, base = random.Random(8), datetime(2024, 1, 1)
    rows = [("ab"[k % 2], base + timedelta(minutes=k), k, rng.gauss(10, 1) + (4 if 300 < k < 330 else 0)) for k in range(600)]
    rows += [("a", base + timedelta(minutes=600), 601, None), ("unknown", base, 602, 1.0), ("b", base + timedelta(minutes=599), 600, 11.0)]  # no value, no limits, a tie in time
    points = spark.createDataFrame([r for r in rows if r[3] is not None and r[0] != "unknown"], online.POINT)
    series = cut(numbered(points, "scope", ["t", "point_id"]).select("scope", "seq", F.col("point_id").cast("string").alias("panel_id"), "x"))
    limits = cut(online.limits_of(series))
    chart = spc.Chart(weight=0.3, decision=4.0)
    want = spc.alarms_of(spc.control_points(series, chart), chart).collect()
    assert len({r.signal for r in want}) >= 5
    online.use_state_store(spark)

    def run():
        stream = spark.readStream.schema(online.POINT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/points")
        out = online.online_alarms(stream, limits, chart).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(online.ALARM).parquet(f"{tmp_path}/out").collect()

    for part in (rows[:100], rows[100:250]):
        spark.createDataFrame(part, online.POINT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/points")
    before = run()
    spark.createDataFrame(rows[250:], online.POINT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/points")
    after = run()  # a new query on the old checkpoint
    near = lambda rows: sorted((r.scope, r.seq, r.panel_id, r.chart, r.signal, round(r.value, 6), round(r.control_limit, 6), r.direction, r.severity) for r in rows if r.signal != "late")
    key = lambda r: r[:5]
    assert sorted(map(key, near(after))) == sorted(map(key, near(want))) and set(before) <= set(after)
    assert all(abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 1e-5 and a[7:] == b[7:] for a, b in zip(near(after), near(want), strict=True))
    spark.createDataFrame([("a", base + timedelta(minutes=3), 999, 50.0), ("a", base + timedelta(days=9), 1000, 10.0)], online.POINT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/points")
    late = [r for r in run() if r not in after]
    assert [r.panel_id for r in late if r.signal == "late"] == ["999"] and all(r.panel_id == "1000" for r in late if r.signal != "late")
