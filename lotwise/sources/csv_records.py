"""Defect records from CSV files, plain or mapped by a declarative configuration."""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.lineage import cut
from lotwise.operators.quality_checks import record_errors

#: Fixed names: the columns that a plain defect file must have, in any order.
REQUIRED = ["panel_id", "component_row", "component_col", "source_system", "defect_type", "x", "y", "size", "confidence_score"]
TYPES = {"component_row": "int", "component_col": "int", "x": "double", "y": "double", "size": "double", "confidence_score": "double"}


def read_defect_csv(spark: SparkSession, path: str | list[str], skip_invalid: bool = False) -> DataFrame:
    """Typed records of a plain file; extra columns are ignored and match_id is null.

    A missing column raises. Rows that break a record rule are dropped with ``skip_invalid``; else
    any of them refuses the read.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    created = F.try_to_timestamp("created_at") if "created_at" in raw.columns else F.lit(None).cast("timestamp")
    typed = raw.select(*(F.trim(c).try_cast(TYPES[c]).alias(c) if c in TYPES else F.trim(c).alias(c) for c in REQUIRED), F.lit(None).cast("string").alias("match_id"), F.coalesce(created, F.current_timestamp()).alias("created_at"))
    return _judged(record_errors(typed), F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in REQUIRED[:5])), skip_invalid)


def _judged(judged: DataFrame, place: Column, skip_invalid: bool) -> DataFrame:
    """Drops rows with ``errors``, or refuses the whole read with the number of bad rows and the first five by their place."""
    if not skip_invalid:
        bad = judged.filter(F.size("errors") > 0)
        if (n := bad.count()) > 0:
            shown = bad.select(F.concat_ws(": ", place, F.array_join("errors", ", ")).alias("e")).orderBy("e").limit(5).collect()
            raise ValueError(f"{n} invalid records: " + "; ".join(r.e for r in shown))
    return judged.filter(F.size("errors") == 0).drop("errors")


TEMPLATE = re.compile(r"\{(\w+)\}")


def named_columns(spec) -> list[str]:
    """The file's columns that a mapping entry reads."""
    if not isinstance(spec, dict):
        return [spec] if isinstance(spec, str) else []
    return [] if "value" in spec else TEMPLATE.findall(spec["template"]) if "template" in spec else [spec["column"]]


def mapped_column(spec, cell: Callable[[str], Column]) -> tuple[Column, Column]:
    """Value and fault (null if none) of one mapping entry over a row's cells by name.

    A string names a column and a number is a literal. In an object, ``value`` wins over ``template``
    ("{A}_{B}"), and that over ``column`` with ``default``, ``map`` of texts, ``type`` and ``scale``. A
    missing or empty cell takes the default; a text outside the map takes it too, or is a fault without one.
    """
    fault = F.lit(None).cast("string")
    if isinstance(spec, str):
        spec = {"column": spec}
    if not isinstance(spec, dict):
        return F.lit(spec), fault
    if "value" in spec:
        found = F.lit(spec["value"])
    elif "template" in spec:
        parts = TEMPLATE.split(spec["template"])
        found = F.concat(*(F.coalesce(F.trim(cell(p)), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))
    else:
        default = F.lit(spec.get("default")).cast("string")
        found = F.coalesce(F.nullif(F.trim(cell(spec["column"])), F.lit("")), default)
        if "map" in spec:
            entries = F.create_map(*(F.lit(str(x)) for pair in spec["map"].items() for x in pair))
            mapped = F.coalesce(F.try_element_at(entries, found), default)
            fault = F.when(found.isNotNull() & mapped.isNull(), F.concat(F.lit(f"{spec['column']} has no mapping for "), found))
            found = mapped
    if spec.get("type") in ("int", "float"):
        text, number = found.cast("string"), found.cast("string").try_cast("double")
        fault = F.coalesce(fault, F.when(text.isNotNull() & number.isNull(), F.concat(text, F.lit(" is not a number"))))
        found = number.cast("long") if spec["type"] == "int" else number
    return (found * spec["scale"] if "scale" in spec else found), fault


def cells_of(spark: SparkSession, path: str, names: list[str], delimiter: str, skip: int, encoding: str) -> DataFrame:
    """file, line, and as c0, c1 ... the texts of the columns ``names`` of every record; each file's own header counts.

    A file is read by one task, since quotes may span lines.
    """
    kinds = pa.schema([("file", pa.string()), ("line", pa.int64()), *((f"c{k}", pa.string()) for k in range(len(names)))])

    def picked(file: str, header: list[str], rows: list[list[str]], lines: list[int]) -> pa.RecordBatch:
        cells, out = list(itertools.zip_longest(*rows)), []
        for name in names:
            own = [pa.array(column, pa.string()) for h, column in zip(header, cells, strict=False) if h == name]
            out.append(pc.coalesce(*own[::-1]) if own else pa.nulls(len(rows), pa.string()))  # of equal names the last that the row has
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(lines, pa.int64()), *out], schema=kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                source = io.TextIOWrapper(pa.BufferReader(content.as_buffer()), encoding=encoding, newline="")
                for _ in range(skip):
                    source.readline()
                reader = csv.reader(source, delimiter=delimiter)
                header = [name.strip() for name in next(reader, [])]
                records = ((cells, skip + reader.line_num) for cells in reader if cells)
                while part := list(itertools.islice(records, 10_000)):
                    yield picked(file.as_py(), header, *map(list, zip(*part, strict=True)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, ", ".join(f"{f.name} {'long' if f.name == 'line' else 'string'}" for f in kinds))


def read_mapped_csv(spark: SparkSession, path: str, config: dict | str, skip_invalid: bool = False) -> DataFrame:
    """Records of vendor files by ``config``: columns (target to mapping), delimiter, encoding and skip_rows.

    Quoted and multi-line cells are read as CSV has them. All faults are gathered; one refuses the whole
    read unless ``skip_invalid``. created_at falls back to the time of reading.
    """
    config = json.loads(config) if isinstance(config, str) else config
    names = sorted({c for spec in config["columns"].values() for c in named_columns(spec)})
    raw = cells_of(spark, path, names, config.get("delimiter", ","), int(config.get("skip_rows", 0)), config.get("encoding", "UTF-8"))
    specs = {name: mapped_column(spec, lambda c: F.col(f"c{names.index(c)}")) for name, spec in config["columns"].items()}
    typed = raw.select("file", "line", *(found.alias(name) for name, (found, _) in specs.items()), F.array_compact(F.array(F.lit(None).cast("string"), *(fault for _, fault in specs.values()))).alias("faults"))
    for name in REQUIRED:
        kind = TYPES.get(name, "string")
        typed = typed.withColumn(name, F.col(name).cast("string").try_cast(kind) if name in typed.columns else F.lit(None).cast(kind))
    created = F.try_to_timestamp(F.col("created_at").cast("string")) if "created_at" in typed.columns else F.lit(None).cast("timestamp")
    typed = typed.withColumn("match_id", F.lit(None).cast("string")).withColumn("created_at", F.coalesce(created, F.current_timestamp()))
    judged = record_errors(typed.select("file", "line", "faults", *REQUIRED, "match_id", "created_at")).withColumn("errors", F.concat("faults", "errors")).drop("faults")
    if not skip_invalid:  # read to refuse and again to return: files are parsed and rows judged once
        judged = cut(judged)
    return _judged(judged, F.concat_ws(":", "file", "line"), skip_invalid).drop("file", "line")


def write_defect_csv(records: DataFrame, path: str) -> None:
    records.select(*REQUIRED).write.mode("errorifexists").option("header", True).csv(path)
