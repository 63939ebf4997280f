"""N-gram Jaccard join by MinHash banding.

Documents with equal sets of word n-grams form a class, a node named by a hash of the set's digest;
ids, which may be null or repeat with other texts, never name a node. One text of each class is
hashed into bands chosen for a target recall at the threshold, and only classes that share a band
bucket with another go on. They are gathered into small blocks
of likely neighbours; for each pair of blocks that share a bucket one task compares the full
n-gram sets of all members, by products of 0/1 matrices over the n-grams that occur twice. A task returns
link counts and a spanning forest of its links, never the pairs themselves, so a group of
thousands of near copies costs its members, not its square, in rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import connected_components
from .hash_store import mixed

#: Members and n-grams that a block may hold, on average.
BLOCK_MEMBERS = 1_000
BLOCK_GRAMS = 1_000_000


def banding(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) that reach ``recall`` at ``threshold``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > max_hashes:
            break
        best = (max(bands, 1), rows)
    return best


def ngram_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a shorter text is one n-gram of all its words."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(shared.word_hash.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    grams = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        grams = mixed(grams) + hashes[k : len(hashes) - width + 1 + k]
    return np.unique(mixed(grams))


def minhash_bands(grams: np.ndarray, multipliers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band over ``rows`` minima of multiplicative hashes."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    minima = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), 1024):
        minima = np.minimum(minima, (multipliers[:, None] * low[None, begin : begin + 1024]).min(axis=1))
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = mixed(keys + minima[k::rows].astype(np.uint64))
    return keys


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, set digest (two longs), n_grams, band hashes for every document."""
    multipliers = (np.random.default_rng(7).integers(0, 2**31, bands * rows, dtype=np.uint32) << 1) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small_batches(batches):
            out: list[tuple] = []
            for text in batch.column(2).to_pylist():
                grams = ngram_hashes(text, n)
                digest = (int(grams.sum(dtype=np.uint64)), int(mixed(grams ^ np.uint64(len(grams))).sum(dtype=np.uint64)))
                keys = minhash_bands(grams, multipliers, bands, rows) if len(grams) else np.zeros(0, np.uint64)
                out.append((*digest, len(grams), keys.astype(np.int64)))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            digests = [pa.array(np.array(c, np.uint64).astype(np.int64)) for c in columns[:2]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *digests, pa.array(columns[2], pa.int64()), pa.array(list(columns[3]), pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "d1", "d2", "n_grams", "bands"],
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, d1 long, d2 long, n_grams long, bands array<long>")


def place_in_blocks(buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, block: classes that share buckets, dealt into blocks of bounded average size.

    Two rounds of smallest-neighbour labels gather likely neighbours under one label; a label's members
    are dealt by hash over as many blocks as its members and n-grams ask for.
    """
    low = buckets.groupBy("bucket").agg(F.min("node").alias("low"))
    first = buckets.join(low, "bucket").groupBy("node").agg(F.min("low").alias("label"))
    lower = buckets.join(first, "node").groupBy("bucket").agg(F.min("label").alias("low"))
    home = buckets.join(lower, "bucket").groupBy("node").agg(F.min("low").alias("home")).join(sizes, "node")
    parts = home.groupBy("home").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).alias("parts")
    )
    return home.join(parts, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))


def block_pairs(buckets: DataFrame, blocks: DataFrame) -> DataFrame:
    """left, right (left <= right): every two blocks that share a bucket, and each block with itself."""
    at = buckets.join(blocks, "node").select("bucket", "block").distinct()
    other = at.select("bucket", F.col("block").alias("right"))
    apart = at.join(other, "bucket").filter("block < right").select(F.col("block").alias("left"), "right").distinct()
    return blocks.select(F.col("block").alias("left"), F.col("block").alias("right")).distinct().unionByName(apart)


def links_between(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose n-gram sets have Jaccard similarity at least ``threshold`` (exact integer test).

    N-grams that only one set holds cannot be shared; the rest are columns of 0/1 matrices whose product,
    taken some thousand columns at a time, counts the common n-grams of all pairs.
    """
    sides = []
    for sets in (left, right):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sides.append((np.concatenate(sets) if sets else np.zeros(0, np.uint64), owner))
    common = np.intersect1d(sides[0][0], sides[1][0]) if left is not right else _repeated(sides[0][0])
    shared_count = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for grams, owner in sides:
        at = np.searchsorted(common, grams)
        at[at == len(common)] = 0
        keep = common[at] == grams if len(common) else np.zeros(len(grams), bool)
        order = np.argsort(at[keep], kind="stable")
        placed.append((at[keep][order], owner[keep][order]))
    for begin in range(0, len(common), 4096):
        slabs = []
        for (columns, owner), sets in zip(placed, (left, right), strict=True):
            lo, hi = np.searchsorted(columns, [begin, begin + 4096])
            slab = np.zeros((len(sets), min(4096, len(common) - begin)), np.float32)
            slab[owner[lo:hi], columns[lo:hi] - begin] = 1
            slabs.append(slab)
        rows = [np.flatnonzero(s.any(axis=1)) for s in slabs]  # a slab often concerns few of the sets
        shared_count[np.ix_(*rows)] += slabs[0][rows[0]] @ slabs[1][rows[1]].T
    n_left, n_right = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    union = n_left[:, None] + n_right[None, :] - shared_count
    return np.nonzero(shared_count >= threshold * union - 1e-9)


def _repeated(grams: np.ndarray) -> np.ndarray:
    values, counts = np.unique(grams, return_counts=True)
    return values[counts > 1]


class LinkSums:
    """Link counts and a spanning forest over some nodes, of links that arrive part by part as index pairs."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray):
        self.nodes, self.sizes, self.label = nodes, sizes, np.arange(len(nodes))
        self.classes, self.documents = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.nodes)
        for x, y in ((a, b), (b, a)):
            self.classes += np.bincount(x, minlength=n)
            self.documents += np.bincount(x, self.sizes[y], n).astype(np.int64)
        while len(a):
            up, down = self.label[a], self.label[b]
            apart = up != down
            a, b, up, down = a[apart], b[apart], up[apart], down[apart]
            np.minimum.at(self.label, np.maximum(up, down), np.minimum(up, down))
            while ((root := self.label[self.label]) != self.label).any():
                self.label = root

    def frame(self) -> pd.DataFrame:
        """Per linked node: linked classes, linked documents (class sizes) and its root in the links' forest."""
        k = np.flatnonzero(self.classes)
        return pd.DataFrame({"node": self.nodes[k], "classes": self.classes[k], "documents": self.documents[k], "root": self.nodes[self.label[k]]})


def compare_blocks(pairs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, classes, documents, root: link counts and forest edges of every pair of blocks.

    ``members`` has node, block, size and text.
    """
    sides = pairs.select("left", "right", F.col("left").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.filter("left <> right").select("left", "right", F.col("right").alias("block"), F.lit(1).alias("side"))
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "node"])
        sums = LinkSums(frame["node"].to_numpy(np.int64), frame["size"].to_numpy(np.int64))
        n_left = int((frame["side"] == 0).sum())
        sets = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
        left, right = sets[:n_left], sets[n_left:]
        a, b = links_between(left, right or left, threshold)
        if not right:
            a, b = a[keep := a < b], b[keep]
        sums.add(a, b + n_left if right else b)
        return sums.frame()

    dealt = sides.join(members, "block")
    return dealt.groupBy("left", "right").applyInPandas(compare, "node long, classes long, documents long, root long")


def packed_grams(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in shared.small_batches(batches):
        grams = [ngram_hashes(text, n).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("block"), batch.column("size"), pa.array(grams, pa.binary())], ["node", "block", "size", "grams"])


def gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """Replaces ``text`` by ``grams``, the n-gram set as packed 64-bit hashes."""
    return texts.select("node", "block", "size", "text").mapInArrow(lambda batches: packed_grams(batches, n), "node long, block long, size long, grams binary")


def readable(docs: DataFrame) -> DataFrame:
    """doc_id (null as -1), text and text_hash: together, id and hash name a row's text."""
    return docs.select(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def classes_and_links(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, max_hashes: int = 384) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row of ``docs`` (see :func:`readable`), and a row per class.

    A class has its node (a number of its own), its smallest id (rep) with that row's text_hash, its size, the documents linked
    to it, and its component's keeper: (rep, text_hash, node) of the class with the smallest id.
    """
    bands, rows = banding(threshold, recall, max_hashes)
    sketches = shared.written(sketch(docs, n, bands, rows), "sketches")
    classes = sketches.groupBy("d1", "d2", "n_grams").agg(
        F.count("*").alias("size"), F.min(F.struct("doc_id", "text_hash", "bands")).alias("b")
    ).select(
        "d1", "d2", "n_grams", F.monotonically_increasing_id().alias("node"), "size",
        F.col("b.doc_id").alias("rep"), F.col("b.text_hash").alias("text_hash"), F.col("b.bands").alias("bands"),
    )
    classes = shared.written(classes, "classes")
    buckets = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    lone = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    buckets = shared.written(buckets.join(lone, "bucket"), "buckets")
    blocks = shared.written(place_in_blocks(buckets, classes.select("node", "n_grams")), "blocks")
    chosen = classes.select("node", "size", F.col("rep").alias("doc_id"), "text_hash").join(blocks, "node")
    texts = docs.join(chosen, ["doc_id", "text_hash"])
    sets = shared.written(gram_sets(texts, n), "members")
    found = shared.written(compare_blocks(block_pairs(buckets, blocks), sets.dropDuplicates(["node"]), n, threshold), "links")
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("documents").alias("linked"))
    own = F.struct("rep", "text_hash", "node")
    keepers = components.join(classes, "node").groupBy("component").agg(F.min(own).alias("keeper"))
    linked = counts.join(components.join(keepers, "component").select("node", "keeper"), "node")
    info = classes.join(linked, "node", "left").select(
        "d1", "d2", "n_grams", "node", "rep", "text_hash", "size", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("keeper", own).alias("keeper")
    )
    info = shared.written(info, "class-info")
    shared.discard(classes, buckets, blocks, sets, found, components)
    return sketches, info


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, max_hashes: int = 384) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links, component_id, kept.

    class_id is the smallest id with the same n-gram set (words in lower case, ASCII white space between
    them); n_links counts the other documents whose set has Jaccard similarity of at least
    ``threshold``, copies included; component_id is the smallest id reachable over links; kept is
    doc_id = component_id. Texts without a word (null, empty, white) form one class and link with nothing
    else. A text of fewer than ``n`` words is one n-gram. A null id is read as -1; rows that repeat an id
    are counted each, and differing texts of one id (or of null ids) are compared each. An empty table
    gives an empty result; other columns are ignored.
    """
    sketches, info = classes_and_links(readable(docs), n, threshold, recall, max_hashes)
    rows, key = sketches.select("doc_id", "d1", "d2", "n_grams"), ["d1", "d2", "n_grams"]
    groups = info.select(*key, "rep", "size", "linked", F.col("keeper.rep").alias("component"))
    marked = shared.join_by_group(rows, groups, groups.filter(F.col("size") * shared.HEAVY_SHARE >= rows.count()), key)
    return marked.select(
        "doc_id", F.col("rep").alias("class_id"), F.col("size").alias("class_size"), (F.col("size") - 1 + F.col("linked")).alias("n_links"),
        F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, exactly one row of each group of near duplicates (of its smallest id), columns unchanged.

    The row is found by id and text, so null and repeated ids neither save a copy nor drop another text; of
    rows that repeat both one stays (they are reduced within each task before the shuffle), and one of all texts without a word. An empty table stays empty; other
    columns, whatever their names, are kept.
    """
    sketches, info = classes_and_links(readable(docs))
    shared.discard(sketches)
    kept = info.filter("node = keeper.node").select(F.col("rep").alias("kept_id"), F.col("text_hash").alias("kept_text"))
    named = shared.row_and_columns(
        docs, F.coalesce("doc_id", F.lit(-1)).cast("long").alias("kept_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("kept_text")
    )
    return named.dropDuplicates(["kept_id", "kept_text"]).join(kept, ["kept_id", "kept_text"], "left_semi").select(*shared.row_fields(docs))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(shared.documents(spark, sf_dir))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
