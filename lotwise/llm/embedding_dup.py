"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Rows with equal vectors form a class. A class's vector is scaled to unit length and quantised to int8
with its own step; the length e of its quantisation error is measured, not assumed. For two vectors
the quantised product differs from the cosine by at most e_x + e_y + e_x e_y, so most pairs are
surely below the threshold or surely above it. Classes are dealt into blocks; only codes, steps and
errors travel to the pairs of blocks, where a task multiplies two blocks tile by tile (int8 values in
float32 matrices, where sums up to 2^24 are exact). It returns link counts and a spanning forest of
the sure links, and the classes that have a pair within the bound; their doubles are fetched and those pairs
computed in full precision in a second pass over the same pairs of blocks. Pairs never leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import connected_components
from .near_dup import LinkSums

#: Vectors a block holds at most and, while there are enough of them for every core, at least.
BLOCK_ROWS, LEAST_ROWS = 8_192, 256
TILE = 1_024


class Codes(NamedTuple):
    """Quantised unit vectors: int8 codes (a row each), step and error length of each."""

    codes: np.ndarray
    step: np.ndarray
    error: np.ndarray

    def part(self, begin: int, end: int) -> Codes:
        return Codes(self.codes[begin:end], self.step[begin:end], self.error[begin:end])


def quantise(vectors: np.ndarray) -> Codes:
    """Codes of unit vectors (rows, double precision)."""
    step = np.maximum(np.abs(vectors).max(axis=1, initial=0.0), 1e-300) / 127
    codes = np.rint(vectors / step[:, None])
    error = np.linalg.norm(vectors - codes * step[:, None], axis=1)
    return Codes(codes.astype(np.int8), step, error * (1 + 1e-12) + 1e-12)


def bounded_pairs(left: Codes, right: Codes, threshold: float, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per tile the index pairs whose cosine may reach ``threshold`` and whether it surely does; inside one block only a < b.

    A product of int8 codes of up to 1040 dimensions sums exactly in float32; longer vectors are summed in double.
    """
    kind = np.float32 if left.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    for i in range(0, len(left.codes), TILE):
        one = left.part(i, i + TILE)
        for j in range(i if inside else 0, len(right.codes), TILE):
            other = right.part(j, j + TILE)
            product = one.codes.astype(kind) @ other.codes.astype(kind).T
            # The tile's loosest bound first: most tiles have no candidate at all and end here.
            loose = threshold - (one.error.max() + other.error.max() + one.error.max() * other.error.max()) - 1e-6
            a, b = np.nonzero(product >= kind(loose / (one.step.max() * other.step.max()) if loose > 0 else -np.inf))
            if inside:
                a, b = a[keep := a + i < b + j], b[keep]
            close = product[a, b].astype(np.float64) * one.step[a] * other.step[b]
            bound = one.error[a] + other.error[b] + one.error[a] * other.error[b] + 1e-9
            maybe = close + bound >= threshold
            yield a[maybe] + i, b[maybe] + j, close[maybe] - bound[maybe] >= threshold


def sure_links(left: Codes, right: Codes, threshold: float, inside: bool, add: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Hands the index pairs that surely link to ``add``; returns the indexes of each side with a pair to be computed in full."""
    still_open = [np.zeros(len(side.codes), bool) for side in (left, right)]
    for x, y, sure in bounded_pairs(left, right, threshold, inside):
        add(x[sure], y[sure])
        for side, index in zip(still_open, (x, y), strict=True):
            side[index[~sure]] = True
    if inside:
        still_open = [still_open[0] | still_open[1]] * 2
    return tuple(np.flatnonzero(side) for side in still_open)


def exact_links(left: np.ndarray, right: np.ndarray, threshold: float, inside: bool, add: Callable) -> None:
    """Hands ``add`` the index pairs of unit vectors that the bounds leave open and whose cosine in double precision reaches ``threshold``."""
    for x, y, sure in bounded_pairs(quantise(left), quantise(right), threshold, inside):
        x, y = x[~sure], y[~sure]
        for k in range(0, len(x), 1 << 16):
            part = slice(k, k + (1 << 16))
            exact = np.einsum("ij,ij->i", left[x[part]], right[y[part]]) >= threshold
            add(x[part][exact], y[part][exact])


def unit_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, dim, packed: the unit vector of every row as packed doubles; null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, dims = [], []
            for values in batch.column(1).to_pylist():
                v = np.array(values if values is not None else [], np.float64)  # a null component becomes nan
                live = bool(len(v)) and bool(np.isfinite(v).all()) and bool(v.any())
                if live:  # by a power of two, which is exact: no square leaves the range of doubles
                    v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                norm = math.sqrt(math.fsum((v * v).tolist())) if live else 0.0
                packed.append((v / norm).tobytes() if norm > 0 else None)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["id", "dim", "packed"])

    one = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return one.mapInArrow(run, "id long, dim int, packed binary")


def coded(classes: DataFrame) -> DataFrame:
    """node, dim, size, codes, step, error of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [quantise(np.frombuffer(x, np.float64)[None, :]) for x in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("dim"), batch.column("size"), pa.array([r.codes.tobytes() for r in rows], pa.binary()),
                 pa.array([r.step[0] for r in rows], pa.float64()), pa.array([r.error[0] for r in rows], pa.float64())],
                ["node", "dim", "size", "codes", "step", "error"],
            )

    return classes.select("node", "dim", "size", "packed").mapInArrow(run, "node long, dim int, size long, codes binary, step double, error double")


def sides_of(frame: pd.DataFrame) -> list[pd.DataFrame]:
    """The rows of the left and the right block of a pair, once if they are the same."""
    own = int(frame["left"].iloc[0]), int(frame["right"].iloc[0])
    return [frame[frame["block"] == k].sort_values("node") for k in dict.fromkeys(own)]


LINKS = "node long, classes long, documents long, root long"


def links_of_blocks(codes: DataFrame, classes: DataFrame, threshold: float, n_blocks: int, tasks: int) -> DataFrame:
    """node, classes, documents, root: link counts and forest edges of every pair of blocks."""
    placed = codes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int"))
    # Block b meets itself and every later block: the pair (left, right) gets both blocks' rows, once each.
    as_left = placed.select("*", F.explode(F.sequence("block", F.lit(n_blocks - 1))).alias("right")).withColumn("left", F.col("block"))
    as_right = placed.filter("block > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("left")).withColumn("right", F.col("block"))
    dealt = as_left.unionByName(as_right).repartition(tasks, "left", "right", "dim")

    columns = ["node", "classes", "documents", "root", "left", "right", "block"]

    def sums_of(sides: list[pd.DataFrame]) -> tuple[LinkSums, Callable]:
        sums, shift = LinkSums(*(np.concatenate([f[k].to_numpy(np.int64) for f in sides]) for k in ("node", "size"))), len(sides[0]) if len(sides) > 1 else 0
        return sums, lambda a, b: sums.add(a, b + shift)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sides = sides_of(frame)
        sums, add = sums_of(sides)
        if not all(len(f) for f in sides):
            return sums.frame().assign(left=0, right=0, block=0)[columns]
        of = [Codes(np.frombuffer(b"".join(f["codes"]), np.int8).reshape(len(f), -1), f["step"].to_numpy(), f["error"].to_numpy()) for f in sides]
        still_open = sure_links(of[0], of[-1], threshold, len(sides) == 1, add)
        to_do = pd.concat([f.iloc[k][["node", "left", "right", "block"]] for f, k in zip(sides, still_open, strict=False)])
        return pd.concat([sums.frame(), to_do.assign(classes=0, documents=0, root=0)])[columns]

    sure = shared.written(dealt.groupBy("left", "right", "dim").applyInPandas(compare, f"{LINKS}, left int, right int, block int"), "sure-links")

    def compute(frame: pd.DataFrame) -> pd.DataFrame:
        sides = sides_of(frame)
        sums, add = sums_of(sides)
        units = [np.frombuffer(b"".join(f["packed"]), np.float64).reshape(len(f), -1) for f in sides]
        if all(map(len, units)):
            exact_links(units[0], units[-1], threshold, len(sides) == 1, add)
        return sums.frame()

    open_rows = sure.filter("left is not null").select("node", "left", "right", "block").join(classes.select("node", "dim", "size", "packed"), "node")
    exact = open_rows.repartition(tasks, "left", "right", "dim").groupBy("left", "right", "dim").applyInPandas(compute, LINKS)
    found = shared.written(sure.filter("left is null").select("node", "classes", "documents", "root").unionByName(exact), "links")
    shared.discard(sure)
    return found


def embedding_links(
    vectors: DataFrame, threshold: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept; every pair of vectors is covered.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and are
    their own component; vectors of different lengths do not link. Rows that repeat an id are each compared
    with their own vector and link with each other where their vectors do. component_id is the smallest id
    reachable (null only if no reachable row has an id); an empty table gives an empty result.
    Work grows with the square of the table, codes shuffled with that of its blocks.
    """
    spark = vectors.sparkSession
    key = ["dim", "h1", "h2"]
    units = shared.written(unit_vectors(vectors, id_column, vector_column).select("*", F.xxhash64("packed").alias("h1"), F.xxhash64(F.lit(1), "packed").alias("h2")), "vectors")
    live = units.filter("packed is not null")
    groups = live.groupBy(*key).agg(F.count("*").alias("size"), F.min("id").alias("low"), F.min("packed").alias("packed"))
    classes = shared.written(groups.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    n, cores = classes.count(), spark.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil(n / block_rows), min(n // LEAST_ROWS, math.ceil(math.sqrt(8 * cores))))
    pairs = n_blocks * (n_blocks + 1) // 2
    codes = shared.written(coded(classes), "codes")
    found = links_of_blocks(codes, classes, threshold, n_blocks, min(pairs, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")) + n_blocks))
    counts = found.groupBy("node").agg(F.sum("documents").alias("linked"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    lowest = components.join(classes, "node").groupBy("component").agg(F.min("low").alias("component_id"))
    reached = components.join(lowest, "component").select("node", "component_id")
    info = classes.join(counts, "node", "left").join(reached, "node", "left").select(
        *key, "size", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")
    )
    info = shared.written(info, "vector-info")
    shared.discard(codes, classes, found, components)
    heavy = info.filter(F.col("size") * shared.HEAVY_SHARE >= units.count())
    marked = shared.join_by_group(units.filter("packed is not null").select("id", *key), info, heavy, key).select("id", "n_links", "component_id")
    alone = units.filter("packed is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return marked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_embedding_links": op6_embedding_links}
ORACLE_SQL = {
    "op6_embedding_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_sum([x * x FOR x IN embedding]) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE array_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
}
