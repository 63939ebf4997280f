"""Text sources do their work once for each record, in as many tasks as there are files."""

import csv

from lotwise.sources import csv_records, klarf, tables

SF = "/root/testdata/sf0.001"
SPEC = "DefectRecordSpec 6 XREL YREL DIECOL DIEROW DEFECTSIZE CLASSNUMBER;\n"


def test_klarf_lines_meet_no_shuffle(spark):
    """What a file's sections say is carried on within its row; before, all lines were sorted by window functions."""
    text = SPEC + "WaferID A;\nUnits MM;\nDefectList\n" + "1 2 3 4 5 6\n" * 3 + "SummarySpec;\nDefectList\n\n#\n 7 8 1 2 1 3;\nSummarySpec\nEndOfFile;\nWaferID B;\nDefectList\n1 1 1 1 1 1"
    rows = klarf.text_rows(spark.createDataFrame([("d/f.txt", bytearray(text.encode()))], "file string, content binary"))
    assert sorted((r.panel_id, r.class_no, r.x) for r in rows.collect()) == [("A", 3, 7.0), *[("A", 6, 1.0)] * 3, ("B", 1, 1.0)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_mapped_csv_is_parsed_once(spark, tmp_path, monkeypatch):
    """Files were parsed for the count of bad rows and again for the result; each text was looked up in a map of the row's cells."""
    monkeypatch.setattr(tables, "VENDOR_ROWS", 1_000)
    rows = tables.mapped_csv(spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan and rows.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_mapped_csv_cells(spark, tmp_path):
    """Short rows, longer ones, a name that the header repeats, blank lines, and files with other headers."""
    with (tmp_path / "a.csv").open("w", newline="") as out:
        csv.writer(out).writerows([["A", "B", "A"], ["1", "2", "3"], ["4", "5"], [], ["6"], ["7", "x\ny", "8", "9"], ["p", 'q"', "r"]])
    (tmp_path / "b.csv").write_text("B\nonly\n")
    cells = csv_records.cells_of(spark, f"{tmp_path}/*.csv", ["A", "B", "C"], ",", 0, "UTF-8")
    found = sorted(((r.file[-5:], r.line, r.c0, r.c1, r.c2) for r in cells.collect()), key=lambda r: r[:2])
    assert found == [("a.csv", 2, "3", "2", None), ("a.csv", 3, "4", "5", None), ("a.csv", 5, "6", None, None), ("a.csv", 7, "8", "x\ny", None), ("a.csv", 8, "r", 'q"', None), ("b.csv", 2, None, "only", None)]
