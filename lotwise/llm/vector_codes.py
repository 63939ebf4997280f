"""Vectors as short codes: every part of a vector is replaced by the number of its nearest codebook entry.

All arithmetic is in integers, so any partitioning gives the same codes. Codebooks are refined in rounds of
one Spark job each: a task assigns the parts of its vectors and returns sums per entry, which Spark adds up;
a round brings one codebook (parts x entries x components) to the driver.

Nearest entries are found by segment means. Over any blocks that a part is cut into, a squared distance is at
least the sum of block size times the squared difference of the means, plus the squared difference of the norms of
what the means leave over. The bounds of the whole part as one block come first, then those of ever smaller
blocks for what is still possible; a bound above a distance already known rules an entry out. What is left
gets its exact distance in 64-bit integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Scale of the integers, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4_096, 8, 16, 6
#: Integers below this in size have exact squared distances in 64 bits for parts of up to 1,024 components.
LARGEST = 1 << 25
#: Vectors that are assigned at a time.
CHUNK = 4_096


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as array<long>; null for a vector that is null or holds a null or non-finite component."""
    v = vector.cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN counts as larger than infinity
    return F.when(usable, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def blocks_of(width: int) -> list[np.ndarray]:
    """Block bounds from coarse to fine: the whole part, its halves, quarters and so on down to pairs of components."""
    found, n = [], 1
    while n == 1 or width // n >= 2:
        found.append(np.linspace(0, width, n + 1).astype(int))
        n *= 2
    return found


def means_and_residuals(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each block times the root of its size, and the norm of what the means leave over, of each row."""
    sizes = np.diff(bounds)
    means = np.add.reduceat(values, bounds[:-1], axis=1) / sizes
    return means * np.sqrt(sizes), np.linalg.norm(values - np.repeat(means, sizes, axis=1), axis=1)


class Codebook:
    """The entries (rows of integers) of one part, with their segment means."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [(bounds, *means_and_residuals(entries, bounds)) for bounds in blocks_of(entries.shape[1])]

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest entry of each row (of equal ones the lowest), its squared distance, and how many distances were computed."""
        rows = np.arange(len(values))
        size = np.abs(values).max(initial=1).astype(np.float64) + np.abs(self.entries).max(initial=1)
        slack = 1e-12 * values.shape[1] * size * size  # rounding of a bound, many times over
        a, b = np.repeat(rows, len(self.entries)), np.tile(np.arange(len(self.entries)), len(rows))
        most = None
        for bounds, means, residuals in self.levels:
            own, left = means_and_residuals(values, bounds)
            bound = ((own[a] - means[b]) ** 2).sum(1) + (left[a] - residuals[b]) ** 2 - slack
            if most is None:  # the entry of the lowest coarse bound gives the first distance
                guess = bound.reshape(len(rows), -1).argmin(1)
                most = ((values - self.entries[guess]) ** 2).sum(1)
            possible = bound <= most[a]
            a, b = a[possible], b[possible]
        least = ((values[a] - self.entries[b]) ** 2).sum(1)
        order = np.lexsort((b, least, a))
        first = order[np.searchsorted(a, rows)]  # ``a`` is ascending, so a row's pairs stand together
        return b[first], least[first], len(a)


def part_matrices(vectors: pa.ListArray, parts: int) -> list[np.ndarray]:
    """The integers of a batch cut into parts, zeros at the end where the parts do not divide the length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    values = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    width = -(-values.shape[1] // parts)
    values = np.pad(values, ((0, 0), (0, width * parts - values.shape[1])))
    return [values[:, k * width : (k + 1) * width] for k in range(parts)]


def assigned(batches: Iterator[pa.RecordBatch], books: list[Codebook]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Slices of batches (column ``v``), with values, entry numbers and distances of each part."""
    for batch in batches:
        for begin in range(0, batch.num_rows, CHUNK):
            rows = batch.slice(begin, CHUNK)
            yield rows, [(values, *book.nearest(values)[:2]) for values, book in zip(part_matrices(rows.column("v"), len(books)), books, strict=True)]


def refined(vectors: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """One round: assigns all parts, then replaces each entry by the floored mean of its parts; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(book.entries) for book in books]
        counts = [np.zeros(len(book.entries), np.int64) for book in books]
        for _, found in assigned(batches, books):
            for k, (values, entry, _) in enumerate(found):
                order = np.argsort(entry, kind="stable")
                used, begins, n = np.unique(entry[order], return_index=True, return_counts=True)
                counts[k][used] += n
                sums[k][used] += np.add.reduceat(values[order], begins, axis=0)
        part, entry, place = (x.ravel() for x in np.indices((len(books), *books[0].entries.shape)))
        out = [*(pa.array(x, pa.int32()) for x in (part, entry, place)), pa.array(np.stack(sums).ravel()), pa.array(np.repeat(np.stack(counts).ravel(), sums[0].shape[1]))]
        yield pa.RecordBatch.from_arrays(out, ["part", "entry", "place", "total", "n"])

    added = vectors.select("v").mapInArrow(run, "part int, entry int, place int, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    entries = np.stack([book.entries for book in books])
    for row in added.filter("n > 0").collect():  # a row per component of a codebook: len(books) * entries * width
        entries[row.part, row.entry, row.place] = row.total // row.n
    return [Codebook(e) for e in entries]


class Codes:
    """Codebooks of a table, and what they make of it. :func:`fit` makes one."""

    def __init__(self, dim: int, books: list[Codebook]):
        self.dim, self.books = dim, books

    def sha256(self) -> str:
        """Of all entries' decimal components, comma-joined by part, entry and place; of nothing for an empty table."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.entries.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The integers that a code (a byte per part) stands for."""
        return np.concatenate([book.entries[k] for book, k in zip(self.books, code, strict=True)])[: self.dim]


def kept_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *others: str) -> DataFrame:
    """id, v and ``others`` of the rows whose vector is usable, written to the shared folder; read anew in every round."""
    v = integers(F.col(vector_column))
    return shared.written(vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), *others).filter("v is not null"), "integer-vectors")


def fits(dim: int) -> Column:
    """Whether a vector has ``dim`` components, all small enough for exact distances."""
    return (F.size("v") == dim) & F.forall("v", lambda x: x.between(1 - LARGEST, LARGEST - 1))


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codebooks of :func:`kept_vectors`: they start as the parts of the ``entries`` smallest ids and are refined ``rounds`` times.

    The first vector sets the number of components; vectors of another length or with a component
    of LARGEST or more take no part. Of rows that repeat an id the smaller vector comes first, null ids come last.
    """
    ranked = kept.filter("size(v) > 0").orderBy(F.col("id").asc_nulls_last(), "v")
    first = ranked.select(F.size("v").alias("dim")).first()
    if first is None:
        return Codes(0, [])
    live = kept.filter(fits(first.dim))
    start = [r.v for r in live.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not start:
        return Codes(first.dim, [])
    books = [Codebook(m) for m in part_matrices(pa.array(start, pa.list_(pa.int64())), parts)]
    for _ in range(rounds):
        books = refined(live, books)
    return Codes(first.dim, books)


def encode(kept: DataFrame, codes: Codes) -> DataFrame:
    """The columns of ``kept`` without v, with code (two hex digits per part) and error (squared distance, summed over parts).

    Both are null for vectors that took no part in :func:`fit`.
    """
    columns = [c for c in kept.columns if c != "v"]
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in columns) + ", code string, error long"
    books = codes.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in assigned(batches, books):
            code = np.stack([entry for _, entry, _ in found], 1).astype(np.uint8)
            error = sum(distance for _, _, distance in found)
            out = [*(rows.column(c) for c in columns), pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*columns, "code", "error"])

    part = fits(codes.dim) if books else F.lit(False)
    none = kept.filter(~part).select(*columns, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return kept.filter(part).mapInArrow(run, schema).unionByName(none) if books else none


def vector_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over the rows of an equal label), codebooks_sha256 of every usable vector.

    Rows whose vector is null or holds a null or non-finite component are dropped; rows that repeat an id or a
    vector are encoded each; null labels are one group; with fewer rows than ``entries`` the codebooks are as
    short; an empty table gives no rows; other columns are never looked at. Vectors of another length than
    the first (by id), empty ones, and those with a component of 8,192 or more in size have null code and error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte per part, so a codebook has 1 to 256 entries")
    group = F.coalesce(F.concat(F.lit("="), F.col(label_column).cast("string")), F.lit("")).alias("label_key")
    kept = kept_vectors(vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), group), "id", "vector", "label_key")
    codes = fit(kept, parts, entries, rounds)
    encoded = shared.written(encode(kept, codes), "vector-codes")
    shared.discard(kept)
    sums = shared.written(encoded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    heavy = sums.filter(F.col("rows") * shared.HEAVY_SHARE >= encoded.count())
    joined = shared.join_by_group(encoded, sums, heavy, ["label_key"])
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """The rounds unrolled as CTEs over single components, without any bound."""
    sql = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) t(part)),
b0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INT AS entry, x AS e
       FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})"""
    nearest = "SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.*, entry, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {book} USING (part)) GROUP BY ALL"
    for k in range(ROUNDS):
        sql += f""",
a{k} AS MATERIALIZED ({nearest.format(book=f"b{k}")}),
m{k} AS (SELECT part, entry, list(mean ORDER BY place) AS e FROM (
    SELECT part, entry, place, floor(sum(x[place]) / count(*))::BIGINT AS mean FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS place FROM a{k}) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN m{k} USING (part, entry))"""
    return (
        sql
        + f""",
z AS ({nearest.format(book=f"b{ROUNDS}")}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, s
"""
    )


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL = {"op11_vector_codes": oracle()}
