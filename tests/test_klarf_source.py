"""The klarf2 data source: commits and aborts, killed tasks, replaced lots, filters, streams of new lots."""

import os

import pytest
from pyspark.sql import functions as F

from lotwise.sources import klarf, klarf_source


def wafers(spark, lots, n=3, size=0.5):
    rows = [(lot, f"W{w}", w, [(k + 1, 1.5 * k, 2.0, size, size, k % 12, 0, 0, 1, 0, 0.75) for k in range(n + w)]) for lot in lots for w in (2, 1)]
    return spark.createDataFrame(rows, f"lot_id string, wafer_id string, slot int, defects {klarf._RECORD}")


def held(spark, path):
    return {(r.lot_id, r.wafer_id): len(r.defects) for r in spark.read.format("klarf2").load(path).collect()}


def test_round_trip_replaced_lots_and_filters(spark, tmp_path):
    klarf_source.register(spark)
    path = f"{tmp_path}/out"
    klarf_source.write_klarf2(wafers(spark, "ABC"), path)
    klarf_source.write_klarf2(wafers(spark, "BD", n=9), f"file://{path}")
    want = {(lot, f"W{w}"): (9 if lot in "BD" else 3) + w for lot in "ABCD" for w in (1, 2)}
    assert held(spark, path) == want
    read = spark.read.format("klarf2").load(path)
    one = read.filter("lot_id = 'B' and wafer_id = 'W1'").first()
    assert [(d.defect_id, d.x, d.class_no, d.confidence) for d in one.defects] == [(k + 1, 1.5 * k, k % 12, 0.75) for k in range(10)] and (one.total_wafers, one.total_defects, one.slot) == (2, 21, 1)
    reader = klarf_source.Klarf2Reader(path, read.schema)
    list(reader.pushFilters([klarf_source.EqualTo(("lot_id",), "B"), klarf_source.EqualTo(("slot",), 1)]))
    assert sum(len(p.names) for p in reader.partitions()) == 1
    assert held(spark, f"{tmp_path}/nothing") == {}


def test_plain_folder_of_files(spark, tmp_path):
    klarf_source.register(spark)
    klarf_source.write_klarf2(wafers(spark, "A"), f"{tmp_path}/out")
    name = klarf_source.Folder(f"{tmp_path}/out").files()[0]["name"]
    os.makedirs(tmp_path / "plain")
    (tmp_path / "plain" / "a.klf2").write_bytes((tmp_path / "out" / name).read_bytes())
    (tmp_path / "plain" / "notes.txt").write_text("no lot")
    assert held(spark, f"{tmp_path}/plain") == {("A", "W1"): 4, ("A", "W2"): 5}


def test_failed_and_killed_tasks_leave_no_lot(spark, tmp_path):
    klarf_source.register(spark)
    path = f"{tmp_path}/out"
    klarf_source.write_klarf2(wafers(spark, "A"), path)
    broken = wafers(spark, "ABCDEFGH").withColumn("slot", F.when(F.col("lot_id") == "F", F.raise_error(F.lit("broken tool"))).otherwise(F.col("slot")))
    with pytest.raises(Exception, match="broken tool"):
        klarf_source.write_klarf2(broken, path)
    assert held(spark, path) == {("A", "W1"): 4, ("A", "W2"): 5} and klarf_source.Folder(path).versions() == [1]
    with open(f"{path}/half.klf2", "wb") as half:  # a task that was killed while it wrote
        half.write(b"KLARF200\x02")
    assert held(spark, path) == {("A", "W1"): 4, ("A", "W2"): 5}
    with pytest.raises(Exception, match="several tasks"):
        wafers(spark, "XX").repartition(4).write.format("klarf2").mode("append").save(path)
    assert klarf_source.Folder(path).versions() == [1] and len(os.listdir(path)) == 3
    with pytest.raises(Exception, match="appends"):
        wafers(spark, "X").write.format("klarf2").mode("overwrite").save(path)


def test_two_commits_get_two_numbers(tmp_path):
    folder = klarf_source.Folder(str(tmp_path))
    assert [folder.commit([folder.write("A", b"x")]), klarf_source.Folder(f"file://{tmp_path}").commit([])] == [1, 2]
    assert [f["lot"] for f in folder.files()] == ["A"] and folder.files(1, 2) == []


def test_stream_of_new_lots(spark, tmp_path):
    klarf_source.register(spark)
    path = f"{tmp_path}/lots"
    klarf_source.write_klarf2(wafers(spark, "AB"), path)

    def run():
        stream = spark.readStream.format("klarf2").load(path).select("lot_id", "wafer_id", F.size("defects").alias("n"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))

    first = [(lot, f"W{w}", 3 + w) for lot in "AB" for w in (1, 2)]
    assert run() == first and run() == first
    klarf_source.write_klarf2(wafers(spark, "C"), path)
    klarf_source.write_klarf2(wafers(spark, "B", n=8), path)
    assert run() == sorted(first + [(lot, f"W{w}", n + w) for lot, n in (("C", 3), ("B", 8)) for w in (1, 2)])


def test_lots_of_more_wafers_than_a_byte_counts(spark, tmp_path):
    """A slot is a byte in the format; larger ones stand in a block that other readers skip."""
    klarf_source.register(spark)
    many = spark.range(1, 301).selectExpr("'A' AS lot_id", "concat('W', id) AS wafer_id", "cast(id AS int) AS slot", f"cast(array() AS {klarf._RECORD}) AS defects")
    klarf_source.write_klarf2(many, f"{tmp_path}/out")
    assert {(r.slot, r.wafer_id, r.total_wafers) for r in spark.read.format("klarf2").load(f"{tmp_path}/out").collect()} == {(k, f"W{k}", 300) for k in range(1, 301)}
    panels = spark.range(1, 301).selectExpr("'A' AS lot_id", "lpad(id, 4, '0') AS panel_id")
    defects = panels.selectExpr("panel_id", "'system_a' AS source_system", "'pit' AS defect_type", "1D AS x", "2D AS y", "0.5D AS size", "0.75D AS confidence_score")
    wafers = klarf.klarf2_wafers(klarf.lot_files(defects, panels, ["x"])).collect()
    assert {(w.slot, w.wafer_id, w.num_defects, w.defects[0].class_no, w.total_wafers) for w in wafers} == {(k, f"{k:04d}", 1, 2, 300) for k in range(1, 301)}
    empty = klarf.wafer_blocks(klarf.np.zeros(0, klarf.DEFECT), slot=70_000)
    rows = klarf.wafer_rows("f", klarf.lot_file("L", [{"n": 0, "blob": empty}] * 70_000, "s", 0))
    assert (rows[0]["slot"], rows[-1]["total_wafers"]) == (70_000, 70_000)
