"""Hierarchical packing of tokenised documents into training windows.

Windows come in tiers (2048, 1024, 512 and 256 tokens by default). A document's whole windows of
the longest tier leave at once; its remainder is routed to the smallest tier that holds it. The
longest tier is packed first: each of its pieces opens a window whose gap is filled best-fit from
shorter tiers, and only when nothing fits is a piece cut. What is left of a shorter tier is packed
into windows of that tier. Windows are full, but for one at the end of a task, which is cut into
powers of two, so nothing is padded. Windows of a tier are dealt over step groups of equal tokens,
heavy and light attention costs mixed.

Every task packs its own documents: no shuffle, no key, and memory bounded by ``pool_tokens``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokenize import encode

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 16_384
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class Pool:
    """Pieces by length; a bit mask of the lengths present finds the best fit."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = defaultdict(list)
        self.mask = 0
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        if n:
            self.by_length[n].append(piece)
            self.mask |= 1 << n
            self.tokens += n

    def take(self, n: int) -> Piece:
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask &= ~(1 << n)
        self.tokens -= n
        return piece

    def longest(self, limit: int) -> int:
        """The greatest length present that is at most ``limit``, or 0."""
        return max((self.mask & ((2 << limit) - 1)).bit_length() - 1, 0)


def fill(pool: Pool, window: int) -> list[Piece]:
    """Takes pieces for one window of the pool's longest pieces; it is full unless the pool runs out."""
    chosen, gap = [pool.take(pool.longest(window))], window
    gap -= len(chosen[0].ids)
    while gap and pool.mask:
        n = pool.longest(gap)
        if n:
            piece = pool.take(n)
        else:  # every piece is longer than the gap: cut the shortest
            whole = pool.take((pool.mask & -pool.mask).bit_length() - 1)
            piece = whole._replace(ids=whole.ids[:gap])
            pool.put(whole._replace(start=whole.start + gap, ids=whole.ids[gap:]))
        chosen.append(piece)
        gap -= len(piece.ids)
    return chosen


def pack_pool(pool: Pool, tiers: tuple[int, ...], final: bool) -> Iterator[tuple[int, list[Piece]]]:
    """Windows as (tier, pieces), longest tier first. Short of the final call an unfilled window goes back."""
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while pool.longest(tier) > below:
            chosen = fill(pool, tier)
            if sum(len(p.ids) for p in chosen) == tier:
                yield tier, chosen
            elif not final:
                for piece in chosen:
                    pool.put(piece)
                return
            else:
                yield from in_powers_of_two(chosen)


def in_powers_of_two(pieces: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
    """Cuts a window that nothing is left to fill into windows of falling powers of two."""
    left, at = sum(len(p.ids) for p in pieces), list(pieces)
    while left:
        size = need = 1 << (left.bit_length() - 1)
        chosen = []
        while need:
            piece = at.pop(0)
            if len(piece.ids) > need:
                at.insert(0, piece._replace(start=piece.start + need, ids=piece.ids[need:]))
                piece = piece._replace(ids=piece.ids[:need])
            chosen.append(piece)
            need -= len(piece.ids)
        left -= size
        yield size, chosen


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A group number per window: equal tokens a group, windows of a tier dealt by cost in snake order."""
    groups, used = [0] * len(windows), 0
    for tier in sorted({tier for tier, _ in windows}, reverse=True):
        own = [k for k, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda k: -sum(len(p.ids) ** 2 for p in windows[k][1]))
        n = -(-len(own) // max(1, step_tokens // tier))
        for rank, k in enumerate(own):
            lap, place = divmod(rank, n)
            groups[k] = used + (place if lap % 2 == 0 else n - 1 - place)
        used += n
    return groups


def pack(
    docs: DataFrame, tokenizer_file: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool_tokens: int = 2_000_000
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group.

    A null or empty text is the single id ``end_id``; rows with repeated or null ids are packed like any
    other; an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    longest = tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        pool, sequence, group = Pool(), base, base
        ready: list[tuple[int, list[Piece]]] = []

        def emit() -> pa.RecordBatch:
            nonlocal sequence, group
            numbers = step_groups(ready, step_tokens)
            rows = []
            for (tier, pieces), number in zip(ready, numbers, strict=True):
                offset = 0
                for p in pieces:
                    n = len(p.ids)
                    rows.append((p.doc_id, p.start, n, p.ids.tobytes(), p.doc_tokens, sequence, offset, tier, group + number))
                    offset += n
                sequence += 1
            group += max(numbers, default=-1) + 1
            ready.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(encode(text, tokenizer_file), "<u4"), np.uint32(end_id))
                whole = len(ids) // longest * longest
                ready += [(longest, [Piece(doc_id, k, ids[k : k + longest], len(ids))]) for k in range(0, whole, longest)]
                pool.put(Piece(doc_id, whole, ids[whole:], len(ids)))
                if pool.tokens + longest * len(ready) >= pool_tokens:
                    ready += pack_pool(pool, tiers, final=False)
                    yield emit()
        ready += pack_pool(pool, tiers, final=True)
        if ready:
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(shared.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
