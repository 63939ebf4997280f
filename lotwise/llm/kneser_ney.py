"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped by workers.

Counting goes down from the longest n-grams. Tasks reduce their tokens to distinct n-grams, packed
per hash part; a shuffle on the part brings equal n-grams together and stores their counts. Each
distinct n-gram then sends what it adds to two sums: to its context (how much follows it, and how many
followers occur once, twice, more often) and to the n-gram without its first word (one more
distinct word before it, or its count where a text begins there; and its count, so the words' own
counts need no shuffle of the text's words). The next shuffle sums both, and so on down to single words. Parts are cut by the hash of the whole n-gram, so a context that a third of
the corpus shares is spread over all of them, and there are as many as the text's size asks for. From
some tens of gigabytes on, n-grams go to their parts in steps of some bits of the hash, each a shuffle
that sums again, so what a task sends to one place never shrinks to a few n-grams. All tables become
sorted hash arrays in the shared folder, a file per part and table, named by the part's number; the
driver gets sums of counts alone. Scoring workers map the files and look up a batch's distinct n-grams
in hash order. N-grams are known by 64-bit hashes; two that clash count as one.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .hash_store import find_numbered, mixed, part_of, runs_of, write_numbered

#: Stand for the start and the end of a text among the 64-bit word hashes.
START, END = np.uint64(1), np.uint64(2)
#: Tokens that a task holds at once when it counts (more of them, fewer repeated n-grams to send) and when it scores.
SLICE_TOKENS, SCORE_TOKENS = 2_000_000, 1_000_000
#: Bytes of text for which there is a part.
PART_BYTES = 12_000_000
#: Bits of the hash by which one shuffle may tell parts apart.
STEP_BITS = 12
#: Words of the longest n-grams. README has the figures of 3 by the check tool.
ORDER = 2
CONTEXT_SUMS = ("total", "n1", "n2", "n3")


def pack(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    for values in arrays:
        np.lib.format.write_array(out, values, allow_pickle=False)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(blob: bytes) -> list[np.ndarray]:
    data, arrays = zstandard.ZstdDecompressor().decompress(blob), []
    source = io.BytesIO(data)
    while source.tell() < len(data):
        arrays.append(np.lib.format.read_array(source, allow_pickle=False))
    return arrays


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, token hashes with END after each document, tokens per document), some million tokens at a time."""
    ids, parts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or "").encode().lower().split()
            ids.append(doc_id)
            parts.append(np.append(np.fromiter(map(shared.word_hash.__getitem__, words), np.uint64, len(words)), END))
            held += len(words) + 1
            if held >= most:
                yield ids, np.concatenate(parts), np.array([len(p) for p in parts])
                ids, parts, held = [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.array([len(p) for p in parts])


def columns_of(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, a column per word, oldest first; START stands before a document."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    columns = [tokens]
    for k in range(1, order):
        before, inside = np.full_like(tokens, START), np.flatnonzero(place >= k)
        before[inside] = tokens[inside - k]
        columns.insert(0, before)
    return columns


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        hashes = mixed(columns[0])
        for column in columns[1:]:
            hashes = mixed(hashes + column)
    return hashes


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in the smallest unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in order, the sums of each column, and the position of one row of each key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(c[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for c in columns]
    return keys[first], sums, order[first]


def by_part(kind: str, keys: np.ndarray, names: list[np.ndarray], sums: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """(kind, part, blob) of rows sorted by key; within a part n-grams go in the order of their words, which compresses."""
    for part, lo, hi in runs_of(part_of(keys, bits)):
        own, counts = [a[lo:hi] for a in names], [a[lo:hi] for a in sums]
        if kind == "gram":
            order = np.lexsort(own[::-1])
            own, counts = [a[order] for a in own], [a[order] for a in counts]
        yield kind, part, pack([*own, *map(narrow, counts)])


def steps_to(bits: int, most: int) -> list[int]:
    """Bits of the hash known after each shuffle: as few shuffles as bring at most ``most`` bits each, as even as can be."""
    n = math.ceil(bits / most)
    return [bits * (k + 1) // n for k in range(n)]


def merged(kind: str, blobs: pd.Series, level: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct hashes in order, what names each (words of an n-gram, else the hash) and its sums; ``level`` is the words of the n-grams."""
    names = level if kind == "gram" else 1
    columns = [np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True)]
    keys, sums, at = summed(gram_hash(columns[:names]) if kind == "gram" else columns[0], columns[names:])
    return keys, [c[at] for c in columns[:names]], sums


def spread(packed: DataFrame, level: int, known: int, wanted: int, bits: int) -> DataFrame:
    """Rows whose parts are told by ``known`` bits, brought to parts of ``wanted`` bits.

    A part of few bits is dealt by its blobs' checksums over as many tasks as it has parts of all ``bits``, so a task
    sums about as much as the final part holds, at any size of the corpus.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kind = frame["kind"].iloc[0]
        keys, names, sums = merged(kind, frame["blob"], level)
        return pd.DataFrame(list(by_part(kind, keys, names, sums, wanted)), columns=["kind", "part", "blob"])

    deal = F.pmod(F.crc32("blob"), F.lit(1 << (bits - known))).alias("deal")
    return packed.groupBy("kind", "part", deal).applyInPandas(run, "kind string, part int, blob binary")


SENT = "kind string, part int, stats array<long>, blob binary"


def count_grams(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Rows of kind gram (words, count), packed per slice and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, lengths in slices(batches, SLICE_TOKENS):
            columns = columns_of(tokens, lengths, order)
            keys, (counts,), at = summed(gram_hash(columns), [np.ones(len(tokens), np.int8)])
            kinds, parts, blobs = zip(*by_part("gram", keys, [c[at] for c in columns], [counts], bits), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "part", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "kind string, part int, blob binary")


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def reduce_parts(packed: DataFrame, folder: str, level: int, first_bits: int) -> DataFrame:
    """Stores n-grams of ``level`` words and contexts of the level above; a row with statistics of each part, and what they send down, by ``first_bits``.

    N-grams below the longest have two sums: what the model takes for their count, and how often they occur. Only single words store both.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kind, part, rows = frame["kind"].iloc[0], int(frame["part"].iloc[0]), []
        keys, words, sums = merged(kind, frame["blob"], level)
        stored = sums if kind == "context" or level == 1 else sums[:1]
        write_numbered(f"{folder}/{f'gram{level}' if kind == 'gram' else f'context{level + 1}'}", part, [keys, *map(narrow, stored)])
        if kind == "gram":
            count, occurs = sums[0], sums[-1]
            rows.append((kind, part, [int(count.sum()), len(keys), *counts_of_counts(count)], None))
        if kind == "gram" and level > 1:
            contexts, sums, _ = summed(gram_hash(words[:-1]), [count, count == 1, count == 2, count > 2])
            down = list(by_part("context", contexts, [contexts], sums, first_bits))
            adds = np.where(words[1] == START, count, 1)
            shorter, sums, at = summed(gram_hash(words[1:]), [adds, occurs])
            down += by_part("gram", shorter, [w[at] for w in words[1:]], sums, first_bits)
            rows += [(k, p, None, blob) for k, p, blob in down]
        return pd.DataFrame(rows, columns=["kind", "part", "stats", "blob"])

    return packed.groupBy("kind", "part").applyInPandas(run, SENT)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2 and D3+ from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 > 0 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))


@dataclass
class NgramModel:
    """A few numbers; the counts themselves stay in the shared folder."""

    folder: str
    order: int
    bits: int
    tokens: int
    words: int
    types: int
    discounts: dict[int, tuple[float, float, float]]  # by level
    reserve: float  # probability that discounting the words leaves to unseen ones

    def find(self, table: str, hashes: np.ndarray, columns: int = 1) -> list[np.ndarray]:
        """Values of each hash in the order given, 0 where it isn't stored; each distinct hash is looked up once."""
        seen, at = np.unique(hashes, return_inverse=True)
        return [values[at] for values in find_numbered(f"{self.folder}/{table}", self.bits, seen, columns)]

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: log10 probability, base score, tokens known."""
        columns = columns_of(tokens, lengths, self.order)
        uniform, own = 1 / (self.words + 1), gram_hash([tokens])
        types, known = self.find("gram1", own, 2)
        probability = np.maximum(types - self._discount(types, 1), 0) / self.types + self.reserve * uniform if self.types else np.full(len(tokens), uniform)
        for level in range(2, self.order + 1):
            words = columns[self.order - level :]
            (count,) = self.find(f"gram{level}", gram_hash(words))
            total, *n = self.find(f"context{level}", gram_hash(words[:-1]), len(CONTEXT_SUMS))
            kept, some = sum(d * x for d, x in zip(self.discounts[level], n, strict=True)), np.maximum(total, 1)
            probability = np.where(total > 0, np.maximum(count - self._discount(count, level), 0) / some + kept / some * probability, probability)
        first = np.cumsum(lengths) - lengths
        base = np.log10((known + 1) / (self.tokens + self.words + 1))
        return np.add.reduceat(np.log10(probability), first), np.add.reduceat(base, first), np.add.reduceat((known > 0).astype(np.int64), first)

    def _discount(self, counts: np.ndarray, level: int) -> np.ndarray:
        return np.array([0.0, *self.discounts[level]])[np.minimum(counts, 3).astype(np.int64)]


def fit(docs: DataFrame, order: int = ORDER, folder: str | None = None, step_bits: int = STEP_BITS) -> NgramModel:
    """Counts all n-grams of ``order`` words (2 at least) of all documents given; an empty table gives the uniform model."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    folder = folder or shared.new_folder(spark, "kneser-ney")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, math.ceil(math.log2(max(size, 1) / PART_BYTES)))
    steps = steps_to(bits, step_bits)
    packed, stats, passed = count_grams(docs, order, steps[0]), {}, []
    for level in range(order, 0, -1):
        for known, wanted in pairwise(steps):
            packed = spread(packed, level, known, wanted, bits)
        done = shared.written(reduce_parts(packed, folder, level, steps[0]), f"grams-{level}")
        shared.discard(*passed)
        sums = done.filter("stats is not null").groupBy("kind").agg(F.array(*(F.sum(F.col("stats")[k]) for k in range(6))).alias("stats"))
        for row in sums.collect():  # one row
            stats[level] = np.array(row.stats, np.int64)
        packed, passed = done.filter("blob is not null").select("kind", "part", "blob"), [done]
    shared.discard(*passed)
    none = np.zeros(6, np.int64)
    of_level = {k: stats.get(k, none).tolist() for k in range(1, order + 1)}
    by_level = {k: discounts(own[2:]) for k, own in of_level.items()}
    types, distinct, m1, m2, *_ = of_level[1]
    d1, d2, d3 = by_level[1]
    reserve = (d1 * m1 + d2 * m2 + d3 * (distinct - m1 - m2)) / types if types else 1.0
    tokens = of_level[order][0]  # each token ends one of the longest n-grams
    return NgramModel(folder, order, bits, tokens, distinct, types, by_level, reserve)


def score_documents(docs: DataFrame, model: NgramModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score; ``perplexity`` is 10 ** (-score / n_tokens).

    Null and empty texts are the single end token. Repeated rows score alike; an empty table gives no rows;
    a text of any length is scored whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, lengths in slices(batches, SCORE_TOKENS):
            score, base, known = model.score(tokens, lengths)
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def is_held_out() -> Column:
    return F.coalesce(shared.crc_bucket("doc_id", 7) == 2, F.lit(False))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs.filter(~is_held_out()))
    return score_documents(docs, model).select(
        "doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


QUERIES = {"op10_kneser_ney": op10_kneser_ney}
ORACLE_SQL: dict[str, str] = {}
