"""KLARF 2.0 as a Spark data source: ``spark.read.format("klarf2").load(folder)``, a committing writer, a stream of new lots.

A folder holds lot files and numbered manifests (``_commits``) that name them; a file that no manifest
names does not count, so a killed task or job leaves no part of a lot to be seen. A lot that is written again
replaces its earlier file. A folder without manifests is read as all of its ``*.klf2`` files. Tasks read
and write files through Arrow's file systems; a lot file is a unit, and small ones share a task.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lotwise.functions.lineage import scratch
from lotwise.plans import fab_view as fab
from lotwise.sources import klarf
from lotwise.sources.klarf import DEFECT, WAFER_SCHEMA, lot_file, numbered_records, typed_defects, wafer_batches, wafer_blocks

#: Bytes of lot files that share a task, unless a single file is larger.
TASK_BYTES = 32 << 20


class Folder:
    """The manifests and files under a path or URI."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))

    def versions(self) -> list[int]:
        infos = self.store.get_file_info(fs.FileSelector(f"{self.root}/_commits", allow_not_found=True))
        return sorted(int(i.base_name[:-5]) for i in infos if i.base_name.endswith(".json") and i.base_name[:-5].isdigit())

    def manifest(self, version: int) -> list[dict]:
        with self.store.open_input_stream(f"{self.root}/_commits/{version:020d}.json") as source:
            return json.loads(source.read())

    def files(self, after: int = 0, upto: int | None = None) -> list[dict]:
        """name, bytes and lot of the files of the versions after ``after``; of a lot written twice the later."""
        versions = [v for v in self.versions() if v > after and (upto is None or v <= upto)]
        if not versions and not after and upto is None:
            infos = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
            return [{"name": i.base_name, "bytes": i.size, "lot": None} for i in sorted(infos, key=lambda i: i.base_name) if i.base_name.endswith(".klf2")]
        lots = {entry["lot"]: entry for v in versions for entry in self.manifest(v)}
        return list(lots.values())

    def write(self, lot: str, content: bytes) -> dict:
        self.store.create_dir(self.root, recursive=True)
        name = f"{uuid.uuid4().hex}.klf2"
        with self.store.open_output_stream(f"{self.root}/{name}") as out:
            out.write(content)
        return {"name": name, "bytes": len(content), "lot": lot}

    def commit(self, files: list[dict]) -> int:
        """Names ``files`` in the next manifest. On a local or mounted file system its number is taken in one step; elsewhere one writer at a time."""
        self.store.create_dir(f"{self.root}/_commits", recursive=True)
        draft = f"{self.root}/_commits/{uuid.uuid4().hex}.draft"
        with self.store.open_output_stream(draft) as out:
            out.write(json.dumps(files).encode())
        while True:
            version = (self.versions() or [0])[-1] + 1
            final = f"{self.root}/_commits/{version:020d}.json"
            if not isinstance(self.store, fs.LocalFileSystem):
                self.store.move(draft, final)
                return version
            try:
                os.link(draft, final)
            except FileExistsError:
                continue
            os.unlink(draft)
            return version

    def remove(self, files: list[dict]) -> None:
        for entry in files:
            self.store.delete_file(f"{self.root}/{entry['name']}")


@dataclass
class LotFiles(InputPartition):
    path: str
    names: tuple[str, ...]


def grouped(path: str, files: list[dict]) -> list[LotFiles]:
    """Files in partitions of about TASK_BYTES."""
    out, names, total = [], [], 0
    for entry in files:
        if names and total + entry["bytes"] > TASK_BYTES:
            out.append(LotFiles(path, tuple(names)))
            names, total = [], 0
        names.append(entry["name"])
        total += entry["bytes"]
    return [*out, LotFiles(path, tuple(names))] if names else out


def read_files(partition: LotFiles, schema: StructType) -> Iterator[pa.RecordBatch]:
    folder, kinds = Folder(partition.path), to_arrow_schema(schema)
    for name in partition.names:
        with folder.store.open_input_stream(f"{folder.root}/{name}") as source:
            yield from wafer_batches(name, source.read(), kinds)


class Klarf2Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.lots = path, schema, None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Equality and membership of lot_id choose files; Spark still checks every row, since a folder may lack manifests."""
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("lot_id",):
                self.lots = {one.value} if self.lots is None else self.lots & {one.value}
            elif isinstance(one, In) and one.attribute == ("lot_id",):
                self.lots = set(one.value) if self.lots is None else self.lots & set(one.value)
            yield one

    def partitions(self) -> Sequence[InputPartition]:
        files = Folder(self.path).files()
        return grouped(self.path, [f for f in files if self.lots is None or f["lot"] is None or f["lot"] in self.lots]) or [LotFiles(self.path, ())]

    def read(self, partition: LotFiles) -> Iterator[pa.RecordBatch]:
        return read_files(partition, self.schema)


class Klarf2Stream(DataSourceStreamReader):
    """Offsets are manifest numbers: a batch are the files of the manifests since the last."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": (Folder(self.path).versions() or [0])[-1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return grouped(self.path, Folder(self.path).files(start["version"], end["version"]))

    def read(self, partition: LotFiles) -> Iterator[pa.RecordBatch]:
        return read_files(partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Klarf2Writer(DataSourceArrowWriter):
    """Rows are wafers (lot_id, wafer_id, slot, defects); a lot's wafers must be in one task (:func:`write_klarf2`)."""

    def __init__(self, path: str, overwrite: bool, station: str, timestamp: int):
        if overwrite:
            raise ValueError("klarf2 appends; a lot that is written again replaces its earlier file")
        self.path, self.station, self.timestamp = path, station, timestamp

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, lots = Folder(self.path), {}
        for batch in iterator:
            defects = batch["defects"]
            values, lengths = defects.flatten(), pc.fill_null(pc.list_value_length(defects), 0).to_numpy()
            every = np.zeros(len(values), DEFECT)
            for field in DEFECT.names:
                if field != "pad":
                    every[field] = pc.fill_null(values.field(field), 0).to_numpy(zero_copy_only=False)
            rows = zip(*(batch[c].to_pylist() for c in ("lot_id", "wafer_id", "slot")), np.split(every, np.cumsum(lengths)[:-1]), strict=True)
            for lot, wafer, slot, records in rows:
                lots.setdefault(lot or "UNKNOWN", []).append((slot or 0, len(records), wafer_blocks(records, wafer_id=(wafer or "")[:16], slot=slot or 0)))
        files = []
        for lot, wafers in lots.items():
            own = [{"n": n, "blob": blob} for _, n, blob in sorted(wafers)]
            files.append(folder.write(lot, lot_file(lot, own, self.station, self.timestamp)))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        lots = [f["lot"] for f in files]
        if len(set(lots)) < len(lots):
            Folder(self.path).remove(files)
            raise ValueError(f"wafers of one lot in several tasks: {sorted({x for x in lots if lots.count(x) > 1})[:5]}")
        if files:
            Folder(self.path).commit(files)

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).remove([f for m in messages if m is not None for f in m.files])


class Klarf2Source(DataSource):
    """Options: ``path``; for writing ``station`` and ``timestamp`` (seconds) of the files."""

    @classmethod
    def name(cls) -> str:
        return "klarf2"

    def schema(self) -> str:
        return WAFER_SCHEMA

    def reader(self, schema: StructType) -> Klarf2Reader:
        return Klarf2Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> Klarf2Stream:  # noqa: N802
        return Klarf2Stream(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Klarf2Writer:
        missing = {"lot_id", "wafer_id", "slot", "defects"} - set(schema.names)
        if missing:
            raise ValueError(f"klarf2 needs the columns {sorted(missing)}")
        return Klarf2Writer(self.options["path"], overwrite, self.options.get("station", "lotwise"), int(self.options.get("timestamp", 0)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Klarf2Source)


def write_klarf2(wafers: DataFrame, path: str) -> None:
    """Writes wafers as one file per lot, all in one commit; each lot in one task, lots over all tasks."""
    register(wafers.sparkSession)
    wafers.repartition("lot_id").sortWithinPartitions("lot_id", "slot").write.format("klarf2").mode("append").save(path)


def klarf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wafers of all lots written to the data source, half of the lots twice, and read back."""
    register(spark)
    folder = scratch(spark, "klarf2")
    wafers = numbered_records(typed_defects(spark, sf_dir), fab.panels(spark, sf_dir), ["defect_key", "x", "y", "size", "confidence_score"])
    write_klarf2(wafers.withColumn("defects", F.slice("defects", 1, 1)).filter("lot_id < 'LOT2'"), folder)  # replaced by the next
    write_klarf2(wafers, folder)
    found = spark.read.format("klarf2").load(folder)
    return found.select("lot_id", "wafer_id", "slot", "process_step", "num_defects", "total_wafers", "total_defects", F.aggregate("defects", F.lit(0).cast("long"), lambda a, d: a + d["class_no"]).alias("class_sum"))


QUERIES = {"klarf_source": klarf_source}
ORACLE_SQL = {"klarf_source": klarf.ORACLE_SQL["klarf_binary"]}
