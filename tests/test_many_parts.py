from lotwise.plans import fab_view as fab


def test_many_parts_are_joined_without_sorting_the_lines(spark, monkeypatch):
    """Beyond what Spark broadcasts, the join with the parts sorted all lines: 1,060 to 1,345 MB in one task at 360 times sf0.1."""
    sf_dir = "/root/testdata/sf0.001"
    columns = ["defect_key", "defect_type", "region_id", "size"]
    few = fab.active_defects(spark, sf_dir).select(*columns)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(fab, "BROADCAST_PARTS", 10)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # the suppliers' two columns stay under it, the parts' don't
        many = fab.active_defects(spark, sf_dir).select(*columns)
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert sorted(many.collect()) == sorted(few.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ShuffledHashJoin [l_partkey" in plan and "SortMergeJoin [l_partkey" not in plan, plan
