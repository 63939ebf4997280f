"""Token-id files with bit- or byte-plane shuffling.

A shard file holds the ids of a range of documents, in ascending document order. Ids are cut into
blocks of fixed size; a block is transposed into byte planes (all first bytes, all second bytes, ...)
or bit planes, and each plane is compressed with zstandard on its own: high planes of small ids
are nearly free. A shard's documents (id, number of ids) follow as one compressed section. The
index is a Parquet table with a row per shard and in it an entry per block; only shards named in
the index count, so a task that is run twice leaves at most an orphan file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokenize import encode

INDEX_SCHEMA = (
    "shard long, file string, first_doc long, n_docs long, n_ids long, docs_at long, docs_size long, "
    "blocks array<struct<at:long,n_ids:int,sizes:array<int>>>"
)
MAGIC = b"LWPLANE1"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Transposes a block of uint32 ids into 4 byte planes or 32 bit planes (lowest first)."""
    columns = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [plane.tobytes() for plane in columns]
    return [np.packbits((columns[bit // 8] >> (bit % 8)) & 1).tobytes() for bit in range(32)]


def from_planes(planes: list[bytes], n_ids: int, kind: str) -> np.ndarray:
    """Inverse of :func:`to_planes`."""
    columns = np.zeros((4, n_ids), np.uint8)
    for k, plane in enumerate(planes):
        if kind == "byte":
            columns[k] = np.frombuffer(plane, np.uint8)
        else:
            columns[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n_ids) << (k % 8)
    return np.ascontiguousarray(columns.T).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard; blocks are written as they fill, so memory is one block and the document list."""

    def __init__(self, folder: str, block_ids: int, kind: str):
        self.block_ids, self.kind = block_ids, kind
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.file = f"shard-{uuid.uuid4().hex}.ids"
        self.out = self.store.open_output_stream(f"{root}/{self.file}")
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.at = self.out.write(MAGIC)
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        self.blocks: list[dict] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        self.doc_ids.append(doc_id)
        self.lengths.append(len(values))
        self.pending.append(values)
        self.n_pending += len(values)
        if self.n_pending >= self.block_ids:
            self.flush(False)

    def flush(self, last: bool) -> None:
        joined = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        whole = len(joined) if last else len(joined) // self.block_ids * self.block_ids
        for begin in range(0, whole, self.block_ids):
            block = joined[begin : min(begin + self.block_ids, whole)]
            planes = [self.zstd.compress(plane) for plane in to_planes(block, self.kind)]
            self.blocks.append({"at": self.at, "n_ids": len(block), "sizes": [len(p) for p in planes]})
            self.at += self.out.write(b"".join(planes))
        self.pending, self.n_pending = [joined[whole:]], len(joined) - whole

    def close(self) -> dict:
        self.flush(True)
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        section = self.zstd.compress(known.tobytes() + ids.tobytes() + np.array(self.lengths, "<i8").tobytes())
        docs_at = self.at
        self.out.write(section)
        self.out.close()
        present = [x for x in self.doc_ids if x is not None]
        return {
            "file": self.file, "first_doc": present[0] if present else None, "n_docs": len(self.doc_ids), "n_ids": sum(self.lengths),
            "docs_at": docs_at, "docs_size": len(section), "blocks": self.blocks,
        }


def read_shard(source, row: dict, kind: str) -> Iterator[tuple[int | None, int, bytes]]:
    """Documents of an open shard in order: id, first position in the shard, ids. Reads block after block."""
    unzip = zstandard.ZstdDecompressor().decompress
    source.seek(row["docs_at"])
    section, n = unzip(source.read(row["docs_size"])), row["n_docs"]
    known, doc_ids, lengths = np.frombuffer(section[:n], np.uint8), np.frombuffer(section[n : 9 * n], "<i8"), np.frombuffer(section[9 * n :], "<i8")
    blocks = iter(row["blocks"])
    rest, position = np.zeros(0, "<u4"), 0
    for present, doc_id, length in zip(known.tolist(), doc_ids.tolist(), lengths.tolist(), strict=True):
        parts, have = [rest], len(rest)
        while have < length:
            block = next(blocks)
            source.seek(block["at"])
            packed, planes = source.read(sum(block["sizes"])), []
            for size in block["sizes"]:
                planes.append(unzip(packed[:size]))
                packed = packed[size:]
            parts.append(from_planes(planes, block["n_ids"], kind))
            have += block["n_ids"]
        joined = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield doc_id if present else None, position, joined[:length].tobytes()
        rest = joined[length:]
        position += length


def write_token_shards(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, block_ids: int = 65_536, planes: str = "byte"
) -> DataFrame:
    """Encodes documents and writes them in ascending doc_id order; returns the shard index.

    Documents are range-partitioned by id and text hash before encoding, so shards are consecutive ranges,
    numbered by ``shard``, and neither a hot source nor one id that a third of all rows repeat fills a task.
    Null text is an empty document (its only id is ``end_id``); null ids come first; rows that repeat an id
    are ordered by a text hash; an empty table gives an empty index; other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, end = None, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer = writer or ShardWriter(f"{folder}/shards", block_ids, planes)
                writer.add(doc_id, encode(text, tokenizer_file) + end)
        if writer:
            row = {"shard": TaskContext.get().partitionId(), **writer.close()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([
                ("shard", pa.int64()), ("file", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("docs_at", pa.int64()), ("docs_size", pa.int64()),
                ("blocks", pa.list_(pa.struct([("at", pa.int64()), ("n_ids", pa.int32()), ("sizes", pa.list_(pa.int32()))]))),
            ]))

    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ordered = placed.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    ordered.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_token_shards(index: DataFrame, folder: str, planes: str = "byte") -> DataFrame:
    """Reads shard files back: doc_id, start (ids of all documents before it), n_tokens, ids (uint32, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{folder}/shards")
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    out, held = [], 0
                    for doc_id, start, ids in read_shard(source, row, planes):
                        out.append((doc_id, row["base"] + start, len(ids) // 4, ids))
                        held += len(ids)
                        if held > 4 << 20:
                            yield _as_batch(out)
                            out, held = [], 0
                    if out:
                        yield _as_batch(out)

    # Two longs per shard (some MB of ids) go through the running sum; the block lists do not.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "shard").repartition(max(1, index.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared.new_folder(spark, "token-planes")
    index = write_token_shards(shared.documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_shards(index, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_token_planes": op1_token_planes}
ORACLE_SQL: dict[str, str] = {}
