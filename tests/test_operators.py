"""Operators on small frames: formulas, sequential references, sources and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lotwise.functions import yield_models as ym
from lotwise.operators import clustering, genealogy, learning, listing, lots, spc
from lotwise.operators.quality_checks import record_errors
from lotwise.sources import commits, csv_records, klarf, tables
from lotwise.streaming import event_windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_yield_models_at_known_points(spark):
    one = F.lit(1.0)
    assert math.isclose(value(spark, ym.poisson(one, one)), math.exp(-1))
    assert math.isclose(value(spark, ym.murphy(one, one)), (1 - math.exp(-1)) ** 2)
    assert math.isclose(value(spark, ym.negative_binomial(one, one, F.lit(2.0))), 1 / 1.5**2)
    assert value(spark, ym.murphy(one, F.lit(0.0))) == 1.0
    assert value(spark, ym.dies_per_wafer(F.lit(300.0), F.lit(49.0))) == 1347
    assert value(spark, ym.dies_per_wafer(F.lit(0.0), F.lit(49.0))) == 0
    for z in (-3.0, -0.5, 0.0, 1.0, 2.5):
        assert abs(value(spark, ym.normal_cdf(F.lit(z))) - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 2e-7


@pytest.mark.parametrize("n,mean,var,alpha", [(3, 1.0, 2.0, 1.0), (9, 0.0, 0.0, 1.0), (9, 1.0, 0.5, 50.0), (20, 1.0, 11.0, 0.1), (9, 10.0, 10.1, 100.0)])
def test_alpha(spark, n, mean, var, alpha):
    assert value(spark, ym.moments_alpha(F.lit(n), F.lit(mean), F.lit(var))) == alpha


@pytest.mark.parametrize("size,fraction", [(0.05, 0.6), (0.2, 1.0), (0.0, 0.3)])
def test_critical_fraction(spark, size, fraction):
    assert math.isclose(value(spark, ym.critical_fraction(F.lit(size), F.lit(0.3), F.lit(0.05))), fraction)


def sequential_dbscan(points, eps, least):
    label, n = {}, 0
    near = {i: [j for j, q in points.items() if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for i, p in points.items()}
    for i in sorted(points):
        if i in label or len(near[i]) < least:
            continue
        queue = [i]
        label[i] = n
        while queue:
            for j in sorted(near[queue.pop(0)]):
                if j not in label:
                    label[j] = n
                    if len(near[j]) >= least:
                        queue.append(j)
        n += 1
    return {i: label.get(i, -1) for i in points}


def test_dbscan_equals_the_sequential_scan(spark):
    rng, rows, want = random.Random(1), [], {}
    for panel in range(12):
        points = {i: (rng.uniform(0, 12), rng.uniform(0, 12)) for i in range(1, 60)}
        rows += [(f"P{panel}", i, x, y, 1.0) for i, (x, y) in points.items()]
        want |= {(f"P{panel}", i): k for i, k in sequential_dbscan(points, 1.0, 3).items()}
    found = clustering.dbscan(spark.createDataFrame(rows, "panel_id string, idx int, x double, y double, eps double"), 3).collect()
    assert {(r.panel_id, r.idx): r.label for r in found} == want


    split = clustering.dbscan(spark.createDataFrame(rows, "panel_id string, idx int, x double, y double, eps double"), 3, task_points=58).collect()
    assert {(r.panel_id, r.idx): r.label for r in split} == want  # by joins


def test_walks_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (1, 4), (9, 9)], "parent long, child long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in genealogy.walk(edges, start).collect()} == {(2, 1), (4, 1), (3, 2)}
    assert {r.node for r in genealogy.walk(edges, start, max_depth=1).collect()} == {2, 4}
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node long")
    assert {r.node for r in genealogy.cyclic_nodes(nodes, edges).collect()} == {1, 2, 3, 4, 9}


def test_softmax_training_separates(spark):
    rows = [("particle", 1.0, 0.1, *[0.0] * 13)] * 15 + [("scratch", 1.0, 2.0, *[0.0] * 13)] * 15
    frame = spark.createDataFrame(rows, "defect_type string, " + ", ".join(f"{f} double" for f in learning.FEATURES))
    weights = learning.train_softmax(frame, ["particle", "scratch"], rate=1.0, rounds=20)
    assert learning.predict(frame, weights, ["particle", "scratch"]).filter("predicted <> defect_type").count() == 0
    with pytest.raises(ValueError):
        learning.train_softmax(frame.limit(3), ["particle", "scratch"])


def test_record_errors(spark):
    rows = [("p", 0, 0, "system_a", 1.0, 0.5), (" ", -1, 0, "x", 0.0, 1.5), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "panel_id string, component_row int, component_col int, source_system string, size double, confidence_score double")
    assert [len(r.errors) for r in record_errors(frame).collect()] == [0, 5, 5]


HEADER = "extra,panel_id,component_row,component_col,source_system,defect_type,x,y,size,confidence_score,match_id\n"


def test_defect_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,P1,0,1,system_a,void,1.5,2.5,.1,.9,m\n2,P1,0,1,system_a,void,1.5,2.5,-1,.9,m\n")
    rows = csv_records.read_defect_csv(spark, str(tmp_path / "a.csv"), skip_invalid=True).collect()
    assert len(rows) == 1 and rows[0].match_id is None and rows[0].size == 0.1
    with pytest.raises(Exception, match="size is not positive"):
        csv_records.read_defect_csv(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "b.csv").write_text("panel_id\nP1\n")
    with pytest.raises(ValueError, match="missing columns"):
        csv_records.read_defect_csv(spark, str(tmp_path / "b.csv"))
    good = csv_records.read_defect_csv(spark, str(tmp_path / "a.csv"), skip_invalid=True)
    csv_records.write_defect_csv(good, str(tmp_path / "out"))
    assert csv_records.read_defect_csv(spark, str(tmp_path / "out")).count() == 1


def test_mapped_csv(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("made by\nsomething\nLOT\tWAF\tR\tC\tKIND\tX\tY\tUM\n" + "L1\tW2\t3.0\t4\tS\t10\t20\t500\nL1\tW3\t1\t\tQ\t10\t20\t700\n")
    config = {
        "delimiter": "\t", "skip_rows": 2,
        "columns": {
            "panel_id": {"template": "{LOT}_{WAF}"}, "component_row": {"column": "R", "type": "int"}, "component_col": {"column": "C", "type": "int", "default": 7}, "source_system": {"value": "system_b"},
            "defect_type": {"column": "KIND", "map": {"S": "scratch"}, "default": "other"}, "x": {"column": "X", "type": "float"}, "y": {"column": "Y", "type": "float", "scale": 0.5}, "size": {"column": "UM", "type": "float", "scale": 0.001}, "confidence_score": 0.75,
        },
    }
    rows = sorted(csv_records.read_mapped_csv(spark, str(tmp_path / "v.tsv"), config).collect(), key=lambda r: r.panel_id)
    assert [(r.panel_id, r.component_row, r.component_col, r.defect_type, r.y, r.size, r.confidence_score) for r in rows] == [("L1_W2", 3, 4, "scratch", 10.0, 0.5, 0.75), ("L1_W3", 1, 7, "other", 10.0, 700 * 0.001, 0.75)]


KLARF = """FileVersion 1 1;
# a comment
WaferID "W1";
Units MICRON;
DefectRecordSpec 7 DEFECTID XREL YREL DIECOL DIEROW DEFECTSIZE CLASSNUMBER ;
DefectList
 1 150000 250000 3 2 800 1
 2 300000 100000 5 4 1200 2
 3 500000 450000 1 1 500 0
 4 1 1 1 1 0 1;
SummarySpec 1 X;
WaferID "W2";
defectlist
 1 450000 1000.5 1.0 1 500 99;
EndOfFile;
"""


def test_klarf_text(spark, tmp_path):
    (tmp_path / "a.klarf").write_text(KLARF)
    rows = klarf.read_klarf(spark, str(tmp_path / "a.klarf")).orderBy("panel_id", "x").collect()
    assert [(r.panel_id, r.component_row, r.component_col, r.x, r.y, r["size"], r.defect_type, r.confidence_score) for r in rows] == [
        ("W1", 2, 3, 150.0, 250.0, 0.8, "particle", 0.75), ("W1", 4, 5, 300.0, 100.0, 1.2, "scratch", 0.75), ("W1", 1, 1, 500.0, 450.0, 0.5, "unclassified", 0.75), ("W2", 1, 1, 450.0, 1.0005, 0.5, "unclassified", 0.75),
    ]
    one = lambda text, **o: [tuple(r) for r in klarf.text_rows(spark.createDataFrame([("d/f.txt", bytearray(text.encode("latin-1")))], "file string, content binary"), **o).collect()]
    spec = "DefectRecordSpec 6 XREL YREL DIECOL DIEROW DEFECTSIZE CLASSNUMBER;\n"
    assert one(spec + "Units MM;\nDefectList\n1 2 3 4 5 6")[0][1:] == ("UNKNOWN_f.txt", 4, 3, 6, 1.0, 2.0, 5.0)  # no end of list
    assert one(spec + "Units MM;\nDefectList\n1 2 3 4 5 6", units="MICRON")[0][5:] == (0.001, 0.002, 0.005)
    assert one(spec + "WaferID A;\nDefectList\n1 2 3 4 5 6\nWaferID B;\nEndOfFile;")[0][1] == "B"  # a wafer named within the list takes its rows
    for bad in (spec + "DefectList\n1 2 x 4 5 6\nEndOfFile;", spec + "DefectList\n1 2\nEndOfFile;", "DefectRecordSpec 1 XREL;", "DefectList\n1 2 3 4 5 6\nEndOfFile;"):
        with pytest.raises(Exception, match="malformed defect record 1|lacks CLASSNUMBER, DEFECTSIZE"):
            one(bad)
    assert one("DefectList\n1 2 3 4 5 6") == [] and one("") == []
    mixed = one(spec + 'WaferID "A é";\r\nDefectList\r1 2 3 4 5 6;\n;\n\tUnits MM ;\nSummarySpec;\n1 1 1 1 1 1\nDefectList\n' + "7 8 1 2 1.5 -3;\n 7 8 1 2 0 1\nEndOfFile;")
    assert sorted(r[1:] for r in mixed) == [("A é", 2, 1, -3, 7.0, 8.0, 1.5), ("A é", 4, 3, 6, 1.0, 2.0, 5.0)]  # units said within a list hold for all of it
    with pytest.raises(ValueError):
        klarf.read_klarf(spark, str(tmp_path / "a.klarf"), source_system="other")


def test_klarf_binary_layout(spark):
    """Bytes laid out by hand, field by field."""
    import struct

    fixed = lambda s, n: s.encode().ljust(n, b"\0")
    block = lambda kind, body: struct.pack("<HI", kind, len(body)) + body
    defect = lambda i, x: struct.pack("<IffffHHHHHHf", i, x, 2.5, 0.25, 0.5, 1, 2, 3, 4, 5, 0, 0.75)
    head = b"KLARF200" + struct.pack("<HH", 2, 0x4949)
    lot = block(2, fixed("L1", 32) + fixed("S", 32) + fixed("D", 32) + fixed("P", 32))
    wafer = lambda name, slot, n: block(4, fixed(name, 16) + struct.pack("<BBHI", slot, 0, 90, n))
    data = head + block(1, fixed("st", 32) + struct.pack("<I", 7) + fixed("v", 16)) + lot + block(3, fixed("r", 32) + struct.pack("<BBfffH", 1, 0, 0.5, 1.5, 2.5, 12))
    data += wafer("A", 1, 2) + wafer("B", 2, 5) + block(5, defect(1, 1.5) + defect(2, 3.5)) + block(77, b"??") + block(5, defect(9, 4.5) + b"cut") + block(6, struct.pack("<HIf", 2, 3, 1.5))
    frame = spark.createDataFrame([("f", bytearray(data + block(0xFFFF, b"")))], "file string, content binary")
    a, b = klarf.klarf2_wafers(frame).orderBy("slot").collect()
    assert (a.lot_id, a.station_id, a.file_timestamp, a.recipe_id, a.die_height_mm, a.num_defect_classes, a.wafer_id, a.orientation, a.total_defects) == ("L1", "st", 7, "r", 2.5, 12, "A", 90, 3)
    assert [(d.defect_id, d.x, d.y_size, d.class_no, d.cluster_no, d.confidence) for d in a.defects] == [(1, 1.5, 0.5, 1, 5, 0.75), (2, 3.5, 0.5, 1, 5, 0.75)]
    assert b.num_defects == 5 and [d.defect_id for d in b.defects] == [9]  # a short list ends early
    panels, defects = klarf.ingested(klarf.klarf2_wafers(frame))
    assert {r.panel_id for r in panels.collect()} == {"KLA_L1_A", "KLA_L1_B"} and {r["size"] for r in defects.collect()} == {0.5} and defects.first().defect_type == "scratch"
    assert len(klarf.wafer_rows("f", data)) == 2  # no end block
    for bad in (b"KLARF201" + data[8:], data[:8] + struct.pack("<HH", 3, 0x4949), data[:8] + struct.pack("<HH", 2, 0x4D4D), data + b"\1", data[:-3], data[:5], head + block(4, b"short")):
        with pytest.raises(ValueError):
            klarf.wafer_rows("f", bad)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 5, None), ("c", 7, "z"), ("c", 6, "q")], "k string, v int, w string")
    assert [tuple(r) for r in tables.first_writer_wins(old, new, ["k"], ["v"]).collect()] == [("c", 6, "q")]
    one = new.filter("v <> 6")
    assert {tuple(r) for r in tables.last_writer_wins(old, new, ["k"], ["v"]).collect()} == {("a", 1, "x"), ("b", 5, None), ("c", 7, "z")}
    assert {tuple(r) for r in tables.merge_columns(old, one, ["k"], ["w"]).collect()} == {("a", 1, "x"), ("b", 2, "y"), ("c", 7, "z")}
    files = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file_path string")
    ledger = spark.createDataFrame([("f1", "failed", 1), ("f1", "processed", 2), ("f2", "failed", 1)], "file_path string, status string, processed_at int")
    assert {r.file_path for r in tables.unprocessed(files, ledger).collect()} == {"f2", "f3"}
    edges = spark.createDataFrame([("a", "b", "split"), ("a", "a", "split"), ("a", "b", "glue")], "parent_lot_id string, child_lot_id string, relation_type string")
    assert tables.checked_edges(edges.limit(1)).count() == 1
    for bad in ("parent_lot_id = child_lot_id", "relation_type = 'glue'"):
        with pytest.raises(Exception, match="itself|unknown relation"):
            tables.checked_edges(edges.filter(bad)).collect()


def test_failed_ingest_is_in_the_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "1,P1,0,1,system_a,void,1.5,2.5,-1,.9,m\n")
    store = commits.Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(ValueError, match="1 invalid"):
        tables.ingest_csv(spark, str(tmp_path / "in"), store)
    (tmp_path / "in" / "a.csv").write_text(HEADER + "1,P1,0,1,system_a,void,1.5,2.5,1,.9,m\n")
    assert tables.ingest_csv(spark, str(tmp_path / "in"), store) == 1 and tables.ingest_csv(spark, str(tmp_path / "in"), store) == 0
    assert tables.ingest_csv(spark, str(tmp_path / "in"), store, skip_if_processed=False) == 1 and store.read("defects").count() == 1
    assert {r.status for r in store.read("files").collect()} == {"failed", "processed"}


def test_specs(spark):
    kind = "spec_id string, die_width_mm double, notes string"
    specs = spark.createDataFrame([("a", 1.0, "x")], kind)
    with pytest.raises(Exception, match="spec exists"):
        tables.insert_spec(specs, specs).collect()
    changed = tables.update_spec(specs, spark.createDataFrame([("a", None, "y"), ("zz", 5.0, "n")], kind))
    assert [tuple(r) for r in changed.collect()] == [("a", 1.0, "y")]


def test_longest_depth_and_lineage(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (7, 8), (8, 7), (8, 9)], "parent long, child long")
    assert {r.node: r.depth for r in genealogy.longest_depth(edges).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 7: None, 8: None, 9: None}
    nodes = spark.createDataFrame([(1,), (3,), (4,)], "node long")
    start = spark.createDataFrame([(3,)], "node long")
    rows = {tuple(r) for r in genealogy.lineage(edges, nodes, start).collect()}
    assert rows == {("self", 3, None, 2), ("ancestor", 1, None, 1), ("descendant", 4, None, 1), ("edge", 1, 3, None), ("edge", 3, 4, None)}
    with pytest.raises(ValueError):
        genealogy.lineage(edges, nodes, spark.createDataFrame([(2,)], "node long"))


def test_lot_status(spark):
    kind = "lot_id string, substrate_type string, panel_id string, defect_density double, yield_negbinom double, pattern string"
    rows = [("L1", "wafer", f"a{i}", d, 0.5, "random") for i, d in enumerate((0.001, 0.001, 0.001, 0.01))]
    rows += [("L2", "wafer", "b", 0.006, 0.5, None), ("L3", "wafer", "c", 0.005, None, "systematic"), ("L4", "wafer", "d", None, None, "excursion")]
    rows += [("L5", "wafer", f"e{i}", d, 0.5, "random") for i, d in enumerate((0.001, 0.001, 0.0011125, 0.001))]
    found = {r.lot_id: (r.lot_status, r.excursion_count, r.near) for r in lots.summarise(spark.createDataFrame(rows, kind)).collect()}
    # three times 1.4 defects on 784 square millimetres is 0.005357
    assert found == {"L1": ("excursion", 1, 0), "L2": ("excursion", 1, 0), "L3": ("watch", 0, 0), "L4": ("excursion", 1, 0), "L5": ("watch", 0, 1)}


def test_greedy_match_equals_a_plain_loop(spark):
    rng, rows, want = random.Random(6), [], set()
    for die in range(30):
        sides = {"system_a": [], "system_b": []}
        for k in range(rng.randrange(12)):
            side = rng.choice(["system_a", "system_b"])
            sides[side].append((f"{die:02}-{k:02}", rng.randrange(6) * 1.0, rng.randrange(6) * 1.0))
        rows += [("P", die, 0, side, key, x, y, 1.5) for side, own in sides.items() for key, x, y in own]
        free = list(sides["system_b"])
        for key, x, y in sides["system_a"]:
            best = min(free, key=lambda b: (math.hypot(b[1] - x, b[2] - y), b[0]), default=None)
            if best and math.hypot(best[1] - x, best[2] - y) <= 1.5:
                free.remove(best)
                want.add((key, best[0]))
    frame = spark.createDataFrame(rows, "panel_id string, component_row int, component_col int, source_system string, defect_key string, x double, y double, match_mm double")
    assert {(r.a_key, r.b_key) for r in learning.match_systems(frame).collect()} == want


def test_pages(spark):
    frame = spark.range(25).withColumn("match_id", F.when(F.col("id") % 2 == 0, "m"))
    rows = listing.page_of(listing.where_equal(frame, matched_only=True), [F.desc("id")], page=2, limit=5).collect()
    assert [r.id for r in rows] == [14, 12, 10, 8, 6] and {r.total for r in rows} == {13}
    assert listing.lookup(frame, "id", 3).count() == 1 and listing.lookup(frame, "id", 99).count() == 0
    with pytest.raises(ValueError):
        listing.page_of(frame, ["id"], page=0)


def test_chart_parameters():
    for bad in ({"weight": 0.0}, {"weight": 1.1}, {"width": 0.0}):
        with pytest.raises(ValueError):
            spc.Chart(**bad)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = event_windows.hourly(event_windows.read_events(spark, str(tmp_path / "in"), events.schema))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r)[:3] for r in spark.table("hours").collect()} == {tuple(r)[:3] for r in event_windows.hourly(events).collect()}
    for _ in range(2):  # a second run over the same files adds nothing
        new = event_windows.read_events(spark, str(tmp_path / "in"), events.schema)
        event_windows.ingest_stream(new, str(tmp_path / "out"), ["event_id"], ["ts"], str(tmp_path / f"c{_}")).awaitTermination(120)
        by_day = new.withColumn("day", F.to_date("ts"))
        event_windows.ingest_stream(by_day, str(tmp_path / "days"), ["event_id", "day"], ["ts"], str(tmp_path / f"d{_}"), within="day").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "days")).count() == events.select("event_id", F.to_date("ts")).distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()


def test_monte_carlo_is_repeatable(spark):
    a, b = (sorted(map(tuple, learning.monte_carlo(spark, 50, 200, 0.5, 100.0).collect())) for _ in range(2))
    assert a == b and abs(sum(y for _, y in a) / 50 - math.exp(-0.5)) < 0.02


def test_all_features_and_classes(spark, tmp_path):
    assert len(learning.FEATURES) == 15
    rows = learning.feature_vectors(spark, "/root/testdata/sf0.001")
    assert rows.count() == rows.filter(" + ".join(learning.REGIONS) + " = 1").count() > 0
    spark.createDataFrame([(f"type {i:03}",) for i in range(70)], "p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert len(learning._classes(spark, str(tmp_path))) == 70


def test_mapped_csv_faults(spark, tmp_path):
    (tmp_path / "a.csv").write_text('KIND,P,NOTE\nS,"P1","two\nlines"\nQ,P2,\n')
    (tmp_path / "b.csv").write_text("P,KIND\nP3,S\n")
    columns = {"panel_id": "P", "component_row": 0, "component_col": 0, "source_system": {"value": "system_a"}, "defect_type": {"column": "KIND", "map": {"S": "scratch"}}, "x": 1, "y": 1, "size": 1, "confidence_score": 0.5}
    read = lambda skip: csv_records.read_mapped_csv(spark, f"{tmp_path}/*.csv", {"columns": columns}, skip)
    assert {(r.panel_id, r.defect_type) for r in read(True).collect()} == {("P1", "scratch"), ("P3", "scratch")}  # each file by its own header
    with pytest.raises(ValueError, match="1 invalid records: .*a.csv:4: KIND has no mapping for Q"):
        read(False)
    (tmp_path / "c.txt").write_bytes("P,KIND\nPé,S\n".encode("latin-1"))
    assert csv_records.read_mapped_csv(spark, f"{tmp_path}/c.txt", {"columns": columns, "encoding": "latin-1"}).first().panel_id == "Pé"
