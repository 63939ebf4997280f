"""KLARF files: the 1.x text form and the 2.0 binary form, one file per row of a distributed read.

A file's bytes are one row (a wafer lot's report, some MB). Text files become defect records by column
functions; binary files become a row per wafer with its defects nested, which an explode turns into records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lotwise.plans import fab_view as fab
from lotwise.plans.fab_view import PREFIX

#: Fixed values of the text form: class names (any other number is unclassified), columns that a record must have.
TEXT_CLASSES = {
    0: "unclassified", 1: "particle", 2: "scratch", 3: "pit", 4: "crystal_defect", 5: "void", 6: "bridging", 7: "metal_spike", 8: "edge_defect", 9: "foreign_material",
}
NEEDED = ("XREL", "YREL", "DEFECTSIZE", "CLASSNUMBER", "DIEROW", "DIECOL")
#: Fixed values of the binary form: class names, file header, block types.
BINARY_CLASSES = {
    0: "particle", 1: "scratch", 2: "pit", 3: "crystal_defect", 4: "metal_spike", 5: "void", 6: "bridging", 7: "mura", 8: "pinhole", 9: "line_defect", 10: "open_circuit",
    11: "short_circuit",
}
MAGIC, VERSION, MARK = b"KLARF200", 2, 0x4949
FILE_INFO, LOT_INFO, SETUP_INFO, WAFER_INFO, DEFECT_LIST, SUMMARY, EOF = 1, 2, 3, 4, 5, 6, 0xFFFF
#: Own blocks for numbers that the format's fields have no room for: they follow the block in question, and other readers skip them.
WIDE_WAFER, WIDE_SUMMARY, MAX_SLOT, MAX_WAFERS = 0x8004, 0x8006, 0xFF, 0xFFFF
#: Fixed layouts, little-endian: file header, block header, and the blocks' fields by name.
HEADER, BLOCK = struct.Struct("<8sHH"), struct.Struct("<HI")
LAYOUT = {
    FILE_INFO: (struct.Struct("<32sI16s"), ("station_id", "file_timestamp", "inspector_version")),
    LOT_INFO: (struct.Struct("<32s32s32s32s"), ("lot_id", "step_id", "device_id", "process_step")),
    SETUP_INFO: (struct.Struct("<32sBBfffH"), ("recipe_id", "inspection_mode", None, "pixel_size_um", "die_width_mm", "die_height_mm", "num_defect_classes")),
    WAFER_INFO: (struct.Struct("<16sBBHI"), ("wafer_id", "slot", "wafer_type", "orientation", "num_defects")),
    SUMMARY: (struct.Struct("<HIf"), ("total_wafers", "total_defects", "mean_defects_per_wafer")),
    WIDE_WAFER: (struct.Struct("<I"), ("slot",)),
    WIDE_SUMMARY: (struct.Struct("<I"), ("total_wafers",)),
}
DEFECT = np.dtype([
    ("defect_id", "<u4"), ("x", "<f4"), ("y", "<f4"), ("x_size", "<f4"), ("y_size", "<f4"), ("class_no", "<u2"), ("rough_bin", "<u2"), ("fine_bin", "<u2"), ("test_no", "<u2"),
    ("cluster_no", "<u2"), ("pad", "<u2"), ("confidence", "<f4"),
])

TEXT_SCHEMA = "file string, panel_id string, component_row int, component_col int, class_no int, x double, y double, size double"
_RECORD = "array<struct<defect_id:long,x:double,y:double,x_size:double,y_size:double,class_no:int,rough_bin:int,fine_bin:int,test_no:int,cluster_no:int,confidence:double>>"
WAFER_SCHEMA = (
    "file string, station_id string, file_timestamp long, inspector_version string, lot_id string, step_id string, device_id string, process_step string, recipe_id string, "
    "inspection_mode int, pixel_size_um double, die_width_mm double, die_height_mm double, num_defect_classes int, wafer_id string, slot int, wafer_type int, orientation int, "
    f"num_defects long, total_wafers int, total_defects long, mean_defects_per_wafer double, defects {_RECORD}"
)


#: Rows in a batch.
BATCH_WAFERS = 16
#: Charsets by the names that Python gives them.
CHARSETS = {"latin-1": "ISO-8859-1", "ascii": "US-ASCII"}


#: Where a line begins within its text, and what parts lines. A line's own white space has no break.
_LINE, _BREAK = r"(?iu)(?<![^\r\n])[^\S\r\n]*", "\r\n|\r|\n"
_SECTION = "struct<wafer:string,unit:string,columns:array<string>,specs:array<array<string>>,body:string>"


def text_sections(files: DataFrame, encoding: str = "latin-1") -> DataFrame:
    """file and sections of 1.x texts: wafer, unit and columns that hold, specs said within it, body (what follows its list's first line).

    A section is what precedes the line that ends its list. Only the few keyword lines are looked at, in their
    text, and what they say is carried on over the array of a file's sections, so no line goes through a shuffle.
    """
    says = lambda c, word: F.startswith(F.upper(c), F.lit(word))
    said = lambda c: F.regexp_replace(F.regexp_replace(c, "^\\S+\\s*|[;\\s]+$", ""), '^"+|"+$', "")
    names = lambda c: F.filter(F.transform(F.slice(F.split(F.regexp_replace(F.translate(c, ";", " "), "\\s+$", ""), "\\s+"), 3, 10_000), lambda w: F.upper(w)), lambda w: w != "")
    last = lambda array: F.try_element_at(array, F.lit(-1))

    def marks(piece: Column) -> Column:
        """A section by itself; each step is bound to a name by the array around it."""
        lines = F.transform(F.regexp_extract_all(piece, F.lit(_LINE + r"((?:WAFERID|UNITS|DEFECTRECORDSPEC)[^\r\n]*)"), F.lit(1)), lambda c: F.regexp_replace(c, "\\s+$", ""))
        body = F.get(F.split(piece, _LINE + r"DEFECTLIST[^\r\n]*", 2), F.lit(1))
        units = lambda keys: F.filter(F.transform(F.filter(keys, lambda c: says(c, "UNITS")), lambda c: F.upper(said(c))), lambda u: u.isin("MICRON", "MM"))
        specs = lambda keys: F.transform(F.filter(keys, lambda c: says(c, "DEFECTRECORDSPEC")), names)
        found = F.transform(F.array(lines), lambda keys: F.struct(last(F.transform(F.filter(keys, lambda c: says(c, "WAFERID")), said)), last(units(keys)), last(specs(keys)), specs(keys), body).cast(_SECTION))
        return F.get(found, F.lit(0))

    def carried(done: Column, own: Column) -> Column:
        known = lambda name: F.coalesce(own[name], last(done)[name])
        return F.array_append(done, F.struct(known("wafer"), known("unit"), known("columns"), own["specs"], own["body"]).cast(_SECTION))

    pieces = F.split(F.decode("content", CHARSETS.get(encoding, encoding)), _LINE + r"(?:SUMMARYSPEC|ENDOFFILE)[^\r\n]*")
    sections = F.aggregate(F.transform(pieces, marks), F.array().cast(f"array<{_SECTION}>"), carried)
    return files.select("file", sections.alias("sections"))


def text_rows(files: DataFrame, units: str | None = None, encoding: str = "latin-1") -> DataFrame:
    """Records of 1.x texts given as (file, content), as TEXT_SCHEMA.

    A file's lines fall into sections, each up to the line that ends its list. Whatever a section says of wafer,
    units (microns unless ``units`` or the file says MM) and columns holds for all of its rows and, until said
    again, for the sections after it; a missing wafer is UNKNOWN_<file>. Rows stand between a list's first
    line and its end, or the file's. A malformed row and a DefectRecordSpec without a needed column raise; rows of no
    size are left out, and so is a list without columns that the file's end cuts off.
    """
    short = F.regexp_extract("file", "[^/]*$", 0)
    lacks = lambda specs: F.filter(F.transform(specs, lambda spec: F.array_sort(F.array_except(F.array(*map(F.lit, NEEDED)), spec))), lambda names: F.size(names) > 0)

    def told(s: Column, k: Column) -> Column:
        """What the rows of a section need, computed once for all of them."""
        return F.struct(
            (k < F.size("sections") - 1).alias("ended"), F.coalesce(F.nullif(s["wafer"], F.lit("")), F.concat(F.lit("UNKNOWN_"), short)).alias("panel_id"), F.coalesce(F.lit(units), s["unit"], F.lit("MICRON")).alias("unit"),
            F.transform(F.array(*map(F.lit, NEEDED)), lambda name: F.array_position(s["columns"], name).cast("int") - 1).alias("at"), F.get(lacks(s["specs"]), F.lit(0)).alias("lacks"),
            F.filter(F.split(s["body"], _BREAK), lambda raw: ~raw.rlike(r"(?iu)^\s*(?:#|$|WAFERID|UNITS|DEFECTRECORDSPEC|DEFECTLIST)")).alias("lines"),
        )

    sections = text_sections(files, encoding).select("file", F.explode(F.transform("sections", told)).alias("s")).select("file", "s.*")
    fault = F.concat(short, F.lit(": DefectRecordSpec lacks "), F.array_join("lacks", ", "))
    listed = sections.filter(F.when(F.col("lacks").isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).select("file", "ended", "panel_id", "unit", "at", F.posexplode("lines").alias("k", "line"))
    # An explode of one row binds a name: what follows refers to it, where a column would be computed anew at each place.
    words = listed.select("*", F.explode(F.array(F.regexp_extract_all(F.regexp_replace("line", ";+\\s*$", ""), F.lit("\\S+"), F.lit(0)))).alias("words"))
    field = {name: F.get("words", F.get("at", F.lit(k))).try_cast("double").alias(name) for k, name in enumerate(NEEDED)}
    rows = words.filter(F.size("words") > 0).select("file", "ended", "panel_id", "unit", "at", "k", "line", F.explode(F.array(F.struct(*field.values()))).alias("v"))
    whole = F.get("at", F.lit(0)).isNotNull()
    malformed = (whole | F.col("ended")) & F.greatest(*(F.col(f"v.{name}").isNull() for name in NEEDED))
    fault = F.when(malformed, F.concat(short, F.lit(": malformed defect record "), F.col("k") + 1, F.lit(": "), F.regexp_replace("line", "^\\s+|\\s+$", "")))
    scale = F.when(F.col("unit") == "MICRON", 0.001).otherwise(1.0)
    found = rows.filter(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(whole & (F.col("v.DEFECTSIZE") * scale > 0)))
    length = lambda name: F.round(F.col(f"v.{name}") * scale, 4).alias
    number = lambda name: F.col(f"v.{name}").cast("int").alias
    return found.select(
        "file", "panel_id", number("DIEROW")("component_row"), number("DIECOL")("component_col"), number("CLASSNUMBER")("class_no"), length("XREL")("x"), length("YREL")("y"), length("DEFECTSIZE")("size"),
    )


def _text(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode("ascii", "replace")


def blocks(file: str, data: bytes) -> Iterator[tuple[int, bytes]]:
    """Type and body of each block up to the end block (or the end of the file)."""
    if len(data) < HEADER.size:
        raise ValueError(f"{file}: too short for a header")
    magic, version, mark = HEADER.unpack_from(data)
    if (magic, version, mark) != (MAGIC, VERSION, MARK):
        raise ValueError(f"{file}: not a little-endian KLARF 2 file: {magic!r}, version {version}, mark {mark:#06x}")
    at = HEADER.size
    while at < len(data):
        if len(data) - at < BLOCK.size:
            raise ValueError(f"{file}: cut within a block header")
        kind, size = BLOCK.unpack_from(data, at)
        at += BLOCK.size
        if kind == EOF:
            return
        if len(data) - at < size:
            raise ValueError(f"{file}: cut within block {kind}")
        yield kind, data[at : at + size]
        at += size


def wafer_heads(file: str, data: bytes | memoryview) -> list[tuple[dict, np.ndarray]]:
    """The fields and defect records of each wafer. The i-th defect list belongs to the i-th wafer, if that came before it.

    A list shorter than its wafer's num_defects ends early; unknown blocks are skipped; a block too short
    for its layout raises. Records are views of ``data``.
    """
    about, wafers, records, lists = {"file": file}, [], [], 0
    for kind, body in blocks(file, memoryview(data)):
        if kind == DEFECT_LIST:
            if lists < len(wafers):
                records[lists] = np.frombuffer(body, DEFECT, min(wafers[lists]["num_defects"], len(body) // DEFECT.itemsize))
            lists += 1
        elif kind in LAYOUT:
            layout, names = LAYOUT[kind]
            if len(body) < layout.size:
                raise ValueError(f"{file}: block {kind} has {len(body)} bytes, needs {layout.size}")
            fields = {k: _text(v) if isinstance(v, bytes) else v for k, v in zip(names, layout.unpack_from(body), strict=True) if k}
            if kind == WAFER_INFO:
                wafers.append(fields)
                records.append(np.zeros(0, DEFECT))
            elif kind == WIDE_WAFER:
                if wafers:
                    wafers[-1] |= fields
            else:
                about |= fields
    return [(about | w, r) for w, r in zip(wafers, records, strict=True)]


def wafer_rows(file: str, data: bytes) -> list[dict]:
    """A dict per wafer, as WAFER_SCHEMA (:func:`wafer_heads`)."""
    names = [k for k in DEFECT.names if k != "pad"]
    return [w | {"defects": [dict(zip(names, row, strict=True)) for row in zip(*(r[k].tolist() for k in names), strict=True)]} for w, r in wafer_heads(file, data)]


def wafer_batches(file: str, data: bytes | memoryview, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The wafers of a file in batches of BATCH_WAFERS with the columns of ``kinds``; no record becomes a Python object."""
    heads = wafer_heads(file, data)
    for begin in range(0, len(heads), BATCH_WAFERS):
        wafers, records = zip(*heads[begin : begin + BATCH_WAFERS], strict=True)
        columns = []
        for kind in kinds:
            if kind.name == "defects":
                every, element = np.concatenate(records), kind.type.value_type
                values = pa.StructArray.from_arrays([pa.array(every[f.name].astype(f.type.to_pandas_dtype())) for f in element], fields=list(element))
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, records)]), pa.int32()), values, type=kind.type))
            else:
                columns.append(pa.array([w.get(kind.name) for w in wafers], kind.type))
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)


def packed(kind: int, **fields) -> bytes:
    """One block from its fields; absent ones are 0 or empty, texts are cut to their width."""
    layout, names = LAYOUT[kind]
    texts = {name for name, x in zip(names, layout.unpack(bytes(layout.size)), strict=True) if isinstance(x, bytes)}
    values = [str(fields.get(name, "")).encode("ascii", "replace") if name in texts else fields.get(name, 0) for name in names]
    return BLOCK.pack(kind, layout.size) + layout.pack(*values)


def wafer_blocks(records: np.ndarray, **wafer) -> bytes:
    """The info and list blocks of one wafer; ``records`` has the fields of DEFECT. A slot over MAX_SLOT stands in a block of its own, the info has MAX_SLOT."""
    body, slot = records.astype(DEFECT).tobytes(), wafer.pop("slot", 0)
    wide = packed(WIDE_WAFER, slot=slot) if slot > MAX_SLOT else b""
    return packed(WAFER_INFO, num_defects=len(records), slot=min(slot, MAX_SLOT), **wafer) + wide + BLOCK.pack(DEFECT_LIST, len(body)) + body


def lot_file(lot: str, wafers: list, station: str, timestamp: int) -> bytes:
    """A whole file from its wafers' packed blocks (``n`` records in ``blob``), in order."""
    total = sum(w["n"] for w in wafers)
    return b"".join([
        HEADER.pack(MAGIC, VERSION, MARK), packed(FILE_INFO, station_id=station, file_timestamp=timestamp, inspector_version="1.0.0"),
        packed(LOT_INFO, lot_id=lot, step_id="AOI", device_id="EXPORT", process_step="FINAL_INSPECTION"),
        packed(SETUP_INFO, recipe_id="EXPORT", pixel_size_um=1.0, die_width_mm=1.0, die_height_mm=1.0, num_defect_classes=len(BINARY_CLASSES)),
        *(bytes(w["blob"]) for w in wafers), packed(SUMMARY, total_wafers=min(len(wafers), MAX_WAFERS), total_defects=total, mean_defects_per_wafer=total / len(wafers)),
        packed(WIDE_SUMMARY, total_wafers=len(wafers)) if len(wafers) > MAX_WAFERS else b"", BLOCK.pack(EOF, 0),
    ])


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """file, content of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _named(number, classes: dict[int, str], other):
    names = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    return F.coalesce(F.try_element_at(names, number), other)


def klarf_records(
    files: DataFrame, source_system: str = "system_a", confidence_score: float = 0.75, classes: dict[int, str] | None = None, units: str | None = None, encoding: str = "latin-1"
) -> DataFrame:
    """Defect records of 1.x text files given as (file, content)."""
    if source_system not in ("system_a", "system_b"):
        raise ValueError(f"unknown source system {source_system!r}")
    return text_rows(files, units, encoding).select(
        "file", "panel_id", "component_row", "component_col", F.lit(source_system).alias("source_system"), _named(F.col("class_no"), classes or TEXT_CLASSES, F.lit("unclassified")).alias("defect_type"),
        "x", "y", "size", F.lit(confidence_score).alias("confidence_score"), F.lit(None).cast("string").alias("match_id"),
    )


def read_klarf(spark: SparkSession, path: str, **options) -> DataFrame:
    """:func:`klarf_records` of the files under ``path``."""
    return klarf_records(files_of(spark, path), **options)


def klarf2_wafers(files: DataFrame) -> DataFrame:
    """A row per wafer (WAFER_SCHEMA) of 2.0 binary files given as (file, content)."""
    kinds = to_arrow_schema(StructType.fromDDL(WAFER_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                yield from wafer_batches(file.as_py(), content.as_buffer(), kinds)

    return files.select("file", "content").mapInArrow(run, WAFER_SCHEMA)


def read_klarf2(spark: SparkSession, path: str) -> DataFrame:
    """:func:`klarf2_wafers` of the files under ``path``."""
    return klarf2_wafers(files_of(spark, path))


def ingested(wafers: DataFrame, prefix: str = "KLA", substrate_type: str = "wafer", source_system: str = "system_a") -> tuple[DataFrame, DataFrame]:
    """Panels (one per wafer, a 1 x 1 grid) and defects to append; nothing is written.

    A defect's size is the larger of its extents; an unknown class number n is class_<n>.
    """
    lot = F.coalesce("lot_id", F.lit("UNKNOWN"))
    named = wafers.withColumn("panel_id", F.concat_ws("_", F.lit(prefix), lot, "wafer_id")).withColumn("lot_id", lot)
    panels = named.select("panel_id", F.lit(substrate_type).alias("substrate_type"), F.lit(1).alias("rows"), F.lit(1).alias("cols"), "lot_id", F.lit("KLARF_IMPORT").alias("product_type")).distinct()
    d = named.select("panel_id", F.explode("defects").alias("d"))
    defects = d.select(
        "panel_id", F.lit(0).alias("component_row"), F.lit(0).alias("component_col"), F.lit(source_system).alias("source_system"),
        _named(F.col("d.class_no"), BINARY_CLASSES, F.concat(F.lit("class_"), "d.class_no")).alias("defect_type"), F.col("d.x").alias("x"), F.col("d.y").alias("y"),
        F.greatest("d.x_size", "d.y_size").alias("size"), F.col("d.confidence").alias("confidence_score"),
    )
    return panels, defects


def lot_files(defects: DataFrame, panels: DataFrame, order: list[str], station: str = "lotwise", timestamp: int = 0) -> DataFrame:
    """lot_id, file, content: one 2.0 file per lot with the system_a defects of its panels.

    Slots follow panel ids, defect ids restart at 1 in each wafer in the ``order`` of columns; unknown types
    are class 0. A task packs one wafer at a time; a lot's wafers meet as packed blocks.
    """
    numbers = {v: k for k, v in BINARY_CLASSES.items()}
    chosen = defects.filter("source_system = 'system_a'").select("panel_id", "defect_type", "x", "y", F.col("size").alias("extent"), "confidence_score", F.struct(*order).alias("o"))
    ranked = chosen.withColumn("k", F.row_number().over(Window.partitionBy("panel_id").orderBy("o"))).drop("o")
    slots = panels.select("lot_id", "panel_id", F.row_number().over(Window.partitionBy("lot_id").orderBy("panel_id")).alias("slot"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["k"].notna()].sort_values("k")
        records = np.zeros(len(own), DEFECT)
        for field, column in (("defect_id", "k"), ("x", "x"), ("y", "y"), ("x_size", "extent"), ("y_size", "extent"), ("confidence", "confidence_score")):
            records[field] = own[column].to_numpy()
        records["class_no"] = [numbers.get(t, 0) for t in own["defect_type"]]
        records["test_no"] = 1
        first = frame.iloc[0]
        blob = wafer_blocks(records, wafer_id=first["panel_id"][:16], slot=int(first["slot"]))
        return pd.DataFrame([(first["lot_id"], int(first["slot"]), len(own), blob)], columns=["lot_id", "slot", "n", "blob"])

    wafers = slots.join(ranked, "panel_id", "left").groupBy("lot_id", "panel_id").applyInPandas(pack, "lot_id string, slot int, n long, blob binary")
    lots = wafers.groupBy("lot_id").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "blob"))).alias("w"))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(lot, f"{lot}.klf2", lot_file(lot, own, station, timestamp)) for lot, own in zip(frame["lot_id"], frame["w"], strict=True)]
            yield pd.DataFrame(out, columns=["lot_id", "file", "content"])

    return lots.mapInPandas(file, "lot_id string, file string, content binary")


def text_files(defects: DataFrame, classes: dict[str, int]) -> DataFrame:
    """file, content: one 1.x file per panel, positions in whole microns, built by column functions alone."""
    micron = lambda c: F.round(F.col(c) * 1000).cast("long")
    number = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), F.col("defect_type")), F.lit(0))
    line = F.concat_ws(" ", F.lit(""), F.lit(1), micron("x"), micron("y"), "component_col", "component_row", micron("size"), number)
    lines = defects.select("panel_id", line.alias("line")).groupBy("panel_id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    head = F.concat(F.lit('FileVersion 1 2;\nWaferID "'), "panel_id", F.lit('";\nUnits MICRON;\nDefectRecordSpec 7 DEFECTID XREL YREL DIECOL DIEROW DEFECTSIZE CLASSNUMBER ;\nDefectList\n'))
    return lines.select(F.concat("panel_id", F.lit(".klarf")).alias("file"), F.concat(head, "body", F.lit(";\nSummarySpec 1 DEFECTS;\nEndOfFile;\n")).cast("binary").alias("content"))


def typed_defects(spark: SparkSession, sf_dir: str, classes: dict[int, str] = BINARY_CLASSES) -> DataFrame:
    """The defects with types that the formats can name, chosen by size."""
    names = F.array(*(F.lit(v) for _, v in sorted(classes.items())))
    return fab.defects(spark, sf_dir).withColumn("defect_type", F.get(names, F.round(F.col("size") * 1000).cast("int") % len(classes)))


def numbered_records(defects: DataFrame, panels: DataFrame, order: list[str]) -> DataFrame:
    """lot_id, wafer_id, slot, defects: the system_a defects of each panel, as :func:`lot_files` numbers them, nested by column functions."""
    numbers = F.create_map(*(F.lit(x) for number, name in BINARY_CLASSES.items() for x in (name, number)))
    own = defects.filter("source_system = 'system_a'").groupBy("panel_id").agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), "x", "y", "size", "confidence_score", "defect_type"))).alias("d"))
    record = F.transform("d", lambda d, k: F.struct(
        (k + 1).cast("long").alias("defect_id"), d["x"].alias("x"), d["y"].alias("y"), d["size"].alias("x_size"), d["size"].alias("y_size"),
        F.coalesce(F.try_element_at(numbers, d["defect_type"]), F.lit(0)).alias("class_no"), F.lit(0).alias("rough_bin"), F.lit(0).alias("fine_bin"), F.lit(1).alias("test_no"), F.lit(0).alias("cluster_no"), d["confidence_score"].alias("confidence"),
    ))
    slots = panels.select("lot_id", "panel_id", F.row_number().over(Window.partitionBy("lot_id").orderBy("panel_id")).alias("slot"))
    return slots.join(own, "panel_id", "left").select("lot_id", F.substring("panel_id", 1, 16).alias("wafer_id"), "slot", F.coalesce(record, F.array().cast(_RECORD)).alias("defects"))


def klarf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects written as 1.x files and read back."""
    made = text_files(typed_defects(spark, sf_dir, TEXT_CLASSES), {v: k for k, v in TEXT_CLASSES.items()})
    return klarf_records(made).select("panel_id", "component_row", "component_col", "defect_type", "x", "y", "size", "confidence_score")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lot_files(typed_defects(spark, sf_dir, BINARY_CLASSES), fab.panels(spark, sf_dir), ["defect_key", "x", "y", "size", "confidence_score"])


def klarf_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots exported as 2.0 files and read back, a row per wafer."""
    wafers = klarf2_wafers(_exported(spark, sf_dir))
    return wafers.select("lot_id", "wafer_id", "slot", "process_step", "num_defects", "total_wafers", "total_defects", F.aggregate("defects", F.lit(0).cast("long"), lambda a, d: a + d["class_no"]).alias("class_sum"))


def klarf_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects that ingesting the exported lots would append."""
    return ingested(klarf2_wafers(_exported(spark, sf_dir)))[1]


QUERIES = {f.__name__: f for f in (klarf_text, klarf_binary, klarf_ingest)}


def _sql_types(classes: dict[int, str]) -> str:
    return f"[{', '.join(repr(v) for _, v in sorted(classes.items()))}][(round(size * 1000)::INT % {len(classes)}) + 1]"


ORACLE_SQL = {
    "klarf_text": PREFIX + f"SELECT panel_id, component_row, component_col, {_sql_types(TEXT_CLASSES)} AS defect_type, round(x, 4) AS x, round(y, 4) AS y, round(size, 4) AS size, 0.75::DOUBLE AS confidence_score FROM defects",
    "klarf_binary": PREFIX + """, n AS (SELECT panel_id, count(*) AS n, sum(round(size * 1000)::INT % 12)::BIGINT AS class_sum FROM defects WHERE source_system = 'system_a' GROUP BY 1)
SELECT lot_id, panel_id AS wafer_id, row_number() OVER (PARTITION BY lot_id ORDER BY panel_id) AS slot, 'FINAL_INSPECTION' AS process_step, coalesce(n, 0) AS num_defects,
  count(*) OVER (PARTITION BY lot_id) AS total_wafers, (sum(coalesce(n, 0)) OVER (PARTITION BY lot_id))::BIGINT AS total_defects, coalesce(class_sum, 0) AS class_sum FROM panels LEFT JOIN n USING (panel_id)""",
    "klarf_ingest": PREFIX + f"""SELECT 'KLA_' || lot_id || '_' || panel_id AS panel_id, 0 AS component_row, 0 AS component_col, source_system, {_sql_types(BINARY_CLASSES)} AS defect_type,
  x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, size::FLOAT::DOUBLE AS size, confidence_score::FLOAT::DOUBLE AS confidence_score FROM defects WHERE source_system = 'system_a'""",
}
