"""Byte-level BPE by ranked merges, folded in Spark over the corpus's distinct words.

Encoding has three steps. (1) Every task reduces its texts to their distinct pre-tokens; a
shuffle makes them distinct over the corpus. (2) Spark higher-order functions fold the merges over
each word's byte array: the pair of lowest rank merges until none is ranked. Ranks come from a
literal table, a perfect hash in arrays, because a literal Spark map is scanned from its start at
each lookup. (3) The words' ids are stored as sorted hash arrays that workers map into memory
to assemble whole texts. Decoding looks up each id's bytes in a literal array and concatenates.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .hash_store import array, part_of, write_part
from .tokenize import LETTERS, PIECES, SPACES

#: Stands for "not ranked".
UNRANKED = 2**31 - 1
#: Buckets of the rank table's perfect hash, as a power of two.
BUCKET_BITS = 14
#: Words of more bytes are folded in windows of WINDOW bytes, or four times the longest token's.
LONG_WORD, WINDOW = 512, 128
#: Distinct words for which there is a dictionary part, and the bits of the least number of parts.
PART_WORDS, LEAST_BITS = 131_072, 5


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def plain_fold(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that ranked merges leave of a token's bytes."""
    pieces = [word[k : k + 1] for k in range(len(word))]
    while len(pieces) > 1:
        low, k = min((ranks.get(a + b, UNRANKED), k) for k, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)))
        if low == UNRANKED:
            break
        pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
    return pieces


def all_reached(ranks: dict[bytes, int]) -> bool:
    """Whether merges make every token of its bytes, which windows of long words rely on."""
    return all(len(plain_fold(token, ranks)) == 1 for token in ranks)


def spark_hash(value: bytes) -> int:
    """Spark's xxhash64 of a binary value, as an unsigned number."""
    return xxhash.xxh64_intdigest(value, seed=42)


def placed_tokens(tokens: list[bytes]) -> tuple[int, list[int], list[int]]:
    """A perfect hash: every token's number in a slot of its own, its hash's low bits xor its bucket's offset.

    Returns slot bits, offsets by bucket, numbers by slot.
    """
    bits = max(4, (4 * len(tokens)).bit_length())
    while True:
        mask, buckets = (1 << bits) - 1, [[] for _ in range(1 << BUCKET_BITS)]
        for number, token in enumerate(tokens):
            h = spark_hash(token)
            buckets[h >> 32 & (1 << BUCKET_BITS) - 1].append((h & mask, number))
        slots: list[int | None] = [None] * (mask + 1)
        offsets = [0] * len(buckets)
        for k in sorted(range(len(buckets)), key=lambda k: -len(buckets[k])):
            places = [low for low, _ in buckets[k]]
            if len(set(places)) < len(places):
                break
            offset = next((x for x in range(mask + 1) if all(slots[low ^ x] is None for low in places)), None)
            if offset is None:
                break
            offsets[k] = offset
            for low, number in buckets[k]:
                slots[low ^ offset] = number
        else:
            return bits, offsets, [number or 0 for number in slots]
        bits += 1


def let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once: Spark lambdas have no other local names.

    A fold over nothing hands its start to the last function as it is; a transform would copy what ``body`` returns.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


class Ranks:
    """A rank table as literal columns: token bytes by rank, and ranks by slot of a perfect hash."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.ranks, self.longest = ranks, max(map(len, tokens), default=1)
        self.bits, offsets, slots = placed_tokens(tokens)
        compact = {"separators": (",", ":")}
        self.token_literal = F.from_json(F.lit(json.dumps([base64.b64encode(t).decode() for t in tokens], **compact)), "array<binary>")
        self.slot_literal = F.from_json(F.lit(json.dumps(slots, **compact)), "array<int>")
        self.offset_literal = F.from_json(F.lit(json.dumps(offsets, **compact)), "array<int>")
        self.hex_literal = F.from_json(F.lit(json.dumps([t.hex() for t in tokens], **compact)), "array<string>")
        self.tokens, self.slots, self.offsets = self.token_literal, self.slot_literal, self.offset_literal

    def rank(self, token: Column) -> Column:
        """Rank of a byte string, UNRANKED if it has none: its one slot holds it, or none does."""
        mask, bucket_mask = F.lit((1 << self.bits) - 1), F.lit((1 << BUCKET_BITS) - 1)

        def look(h: Column) -> Column:
            offset = F.get(self.offsets, F.shiftright(h, 32).bitwiseAND(bucket_mask))
            number = F.get(self.slots, h.bitwiseAND(mask).bitwiseXOR(offset))
            return F.when(F.get(self.tokens, number) == token, number).otherwise(F.lit(UNRANKED))

        return let(F.xxhash64(token), look)

    def encode(self, word: Column) -> Column:
        """Ids of one pre-token given as binary. Each literal stands in the plan once, bound to a name."""

        def with_tokens(tokens: Column) -> Column:
            self.tokens = tokens
            return let(self.slot_literal, with_slots)

        def with_slots(slots: Column) -> Column:
            self.slots = slots
            return let(self.offset_literal, with_offsets)

        def with_offsets(offsets: Column) -> Column:
            self.offsets = offsets
            return self.fold(word)

        return let(self.token_literal, with_tokens)

    def decode(self, ids: Column) -> Column:
        """Concatenated bytes of an array of ids (joined as hex, so the time is linear)."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.hex_literal, i)), ""))

    def fold(self, word: Column) -> Column:
        """The fold of ranked merges over a word's bytes, by :meth:`fold_windows` if there are many.

        Ranks with a token that merges never make have no windows: their long words are folded whole.
        """
        if not all_reached(self.ranks):
            return self.fold_whole(word)
        return F.when(F.octet_length(word) > LONG_WORD, self.fold_windows(word, max(WINDOW, 4 * self.longest))).otherwise(self.fold_whole(word))

    def fold_windows(self, word: Column, window: int) -> Column:
        """The same ids for long words, from folds over overlapping windows, so time grows with the length.

        A sequence of tokens is the encoding of its text if each two neighbours are the encoding of theirs (for
        ranks whose every token is reached by merges). A window's tokens are such a sequence, and so are two windows' tokens
        that are joined at a token which both have at the same place. The next window begins at a token of
        the one before, about its middle; without a common token it begins where the settled tokens end
        and is twice as long, until tokens are settled again; at worst the whole word is one window.
        Tokens are held as ``place << 32 | rank``. A fold copies its state at every step, all but binary values, so
        settled ids are packed as binary and the state stays small.
        """
        n = F.octet_length(word)
        at, rank_of = (lambda key: F.shiftright(key, 32).cast("int")), (lambda key: key.bitwiseAND(F.lit(2**32 - 1)).cast("int"))
        none, few, nothing = F.array().cast("array<bigint>"), F.lit(window), F.lit("").cast("binary")
        packed = lambda ids: F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0")), ""))
        unpacked = lambda out: F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(out) / 4) - 1), lambda k: F.conv(F.hex(F.substring(out, (4 * k + 1).cast("int"), F.lit(4))), 16, 10).cast("int"))

        def placed(ids: Column, begin: Column) -> Column:
            start = F.struct(begin.cast("long").alias("at"), none.alias("keys"))
            step = lambda acc, i: F.struct((acc["at"] + F.octet_length(F.get(self.tokens, i))).alias("at"), F.concat(acc["keys"], F.array(F.shiftleft(acc["at"], 32).bitwiseOR(i.cast("long")))).alias("keys"))
            return F.aggregate(ids, start, step, lambda acc: acc["keys"])

        def state(x: Column, width: Column, keys: Column, out: Column, done: Column) -> Column:
            return F.struct(x.cast("int").alias("x"), width.cast("int").alias("width"), keys.alias("keys"), out.alias("out"), done.alias("done"))

        def next_state(acc: Column, new: Column) -> Column:
            stop = F.least(acc["x"] + acc["width"], n + 1)
            common = F.when(F.size(acc["keys"]) == 0, F.get(new, F.lit(0))).otherwise(F.get(F.array_intersect(acc["keys"], new), F.lit(0)))

            def joined(key: Column) -> Column:
                settled = F.transform(F.filter(acc["keys"], lambda k: k < key), rank_of)

                def go_on(rest: Column) -> Column:
                    ended = stop == n + 1
                    ids = F.when(ended, F.concat(settled, F.transform(rest, rank_of))).otherwise(settled)
                    middle = at(F.array_max(F.filter(rest, lambda k: at(k) <= F.floor((at(key) + stop) / 2))))
                    x = F.greatest(middle, F.coalesce(at(F.get(rest, F.lit(1))), stop))
                    moved = F.coalesce(key > F.get(acc["keys"], F.lit(0)), F.lit(True))
                    return state(x, F.when(moved, few).otherwise(acc["width"]), F.when(ended, none).otherwise(rest), F.concat(acc["out"], packed(ids)), ended)

                return let(F.filter(new, lambda k: k >= key), go_on)

            begin = at(F.get(acc["keys"], F.lit(0)))
            tried = (acc["x"] == begin) & (stop == n + 1)
            apart = F.when(tried, state(F.lit(1), n, none, nothing, F.lit(False))).otherwise(state(begin, acc["width"] * 2, acc["keys"], acc["out"], F.lit(False)))
            return let(common, lambda key: F.when(key.isNull(), apart).otherwise(joined(key)))

        def step(acc: Column, _: Column) -> Column:
            return F.when(acc["done"], acc).otherwise(let(let(F.substring(word, acc["x"], acc["width"]), self.fold_whole), lambda ids: let(placed(ids, acc["x"]), lambda new: next_state(acc, new))))

        start = state(F.lit(1), few, none, nothing, F.lit(False))
        return F.aggregate(F.sequence(F.lit(1), n + 64), start, step, lambda acc: unpacked(acc["out"]))

    def fold_whole(self, word: Column) -> Column:
        """The fold over a word of moderate length.

        Its state are the places where pieces start (with the end) and the rank of each piece joined with
        the next; a merge drops a start and ranks the joined piece with its neighbours.
        """
        n = F.octet_length(word)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: self.rank(F.substring(word, i, F.lit(2))))

        def piece(starts: Column, first: Column, last: Column) -> Column:
            return F.substring(word, F.get(starts, first), F.get(starts, last) - F.get(starts, first))

        def merge(acc: Column, _: Column) -> Column:
            starts, ranks = acc["s"], acc["r"]

            def at(i: Column) -> Column:
                before, after = self.rank(piece(starts, i - 1, i + 2)), F.when(i + 3 < F.size(starts), self.rank(piece(starts, i, i + 3))).otherwise(F.lit(UNRANKED))
                around = F.when(i > 0, F.array(before, after)).otherwise(F.array(after))
                left = F.concat(F.slice(starts, F.lit(1), i + 1), F.slice(starts, i + 3, F.size(starts)))  # slices are copied without a look at their elements
                return F.struct(left.alias("s"), F.concat(F.slice(ranks, F.lit(1), F.greatest(i - 1, F.lit(0))), around, F.slice(ranks, i + 3, F.size(ranks))).alias("r"))

            lowest = lambda low: F.when(low == UNRANKED, acc).otherwise(let(F.array_position(ranks, low).cast("int") - 1, at))
            return let(F.array_min(ranks), lowest)

        start = F.struct(F.sequence(F.lit(1), n + 1).alias("s"), F.concat(pairs, F.array(F.lit(UNRANKED))).alias("r"))
        ids = lambda acc: F.transform(F.slice(acc["s"], F.lit(1), F.size(acc["s"]) - 1), lambda _, k: self.rank(piece(acc["s"], k, k + 1)))
        folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, merge, ids)
        whole = self.rank(word)
        return F.when(n == 0, F.array().cast("array<int>")).when(whole != UNRANKED, F.array(whole)).otherwise(folded)


def rust_white_space(pattern: str) -> str:
    """The pattern with white space spelled out, since engines differ in what ``\\s`` means."""
    return pattern.replace("[^\\s", f"[^{SPACES}").replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]")


#: Whether a piece is letters after at most a space, which is one pre-token.
one_word = re.compile(f" ?[{LETTERS}]+").fullmatch


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a piece to its pre-tokens; a piece of letters after at most a space is one."""
    split = regex.compile(rust_white_space(pattern)).findall
    return lambda piece: [piece] if one_word(piece) else split(piece)


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """The distinct pre-tokens (binary) of all texts; each task sends each of its words once a batch."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, sent = splitter(pattern), set(), set()
        for batch in batches:
            pieces = set()
            for text in batch.column(0).to_pylist():
                pieces.update(PIECES.findall(text or ""))
            pieces -= seen
            words = {piece for piece in pieces if one_word(piece)}
            words = words.union(*map(split, pieces - words)) - sent
            if len(seen) > 700_000:
                seen, sent = set(), set()
            seen |= pieces
            sent |= words
            yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary())], ["word"])

    return docs.select("text").mapInArrow(reduce, "word binary").distinct()


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word, ids: the fold over each distinct word."""
    return words.select("word", Ranks(ranks).encode(F.col("word")).alias("ids"))


def reordered(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``sizes`` values in another order, and the bounds of the runs there."""
    return gathered(values, (np.cumsum(sizes) - sizes)[order], sizes[order])


def gathered(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``sizes`` values from each ``begin``, one after another, and their bounds there."""
    at = np.append(0, np.cumsum(sizes))
    return values[np.arange(at[-1]) + np.repeat(begin - at[:-1], sizes)], at


def write_dictionary(words: DataFrame, ranks: dict[bytes, int], folder: str, bits: int) -> DataFrame:
    """Stores word -> ids as sorted hash arrays; returns part, name. Words are folded in the task that stores them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, sizes, ids, counts = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for batch in batches:
            own = batch.column(0).to_pylist()
            hashes.append(np.fromiter(map(spark_hash, own), np.uint64, len(own)))
            words += own
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
            ids.append(batch.column(1).flatten().to_numpy().astype("<u4"))
            counts.append(np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes)
        hashes = hashes[order]
        word, word_at = reordered(np.frombuffer(b"".join(words), np.uint8), np.concatenate(sizes), order)
        ids, ids_at = reordered(np.concatenate(ids), np.concatenate(counts), order)
        found = []
        bounds = np.searchsorted(part_of(hashes, bits), np.arange((1 << bits) + 1)).tolist()
        for part, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if hi > lo:
                arrays = {"hash": hashes[lo:hi]}
                for key, values, at, width in (("word", word, word_at, 1), ("ids", ids, ids_at, 4)):
                    arrays |= {f"{key}_at": (at[lo : hi + 1] - at[lo]) * width, key: values[at[lo] : at[hi]].view(np.uint8)}
                found.append((part, write_part(folder, arrays)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found])], ["part", "name"])

    part = F.shiftrightunsigned(F.xxhash64("word"), 64 - bits)
    dealt = words.withColumn("word_part", part).repartition(1 << bits, "word_part")
    return encode_words(dealt, ranks).mapInArrow(write, "part int, name string")


class TextEncoder:
    """Whole-text encoding over the mapped dictionary; one per worker process.

    Pieces met before are in a bounded dict; the distinct new ones of a batch are split into words, and all
    their words are looked up together, part by part in hash order. A text is then one lookup per piece.
    """

    def __init__(self, folder: str, pattern: str, names: tuple[tuple[int, tuple[str, ...]], ...], bits: int, limit: int = 1_000_000):
        self.folder, self.bits, self.limit = folder, bits, limit
        self.split, self.parts, self.known = splitter(pattern), dict(names), {}

    def word_ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        return {word: ids for word, ids in zip(words, self.look_up(words), strict=True) if ids is not None}

    def look_up(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of words, in their order; None for a word that the dictionary lacks."""
        hashes = np.fromiter(map(spark_hash, words), np.uint64, len(words))
        order = np.argsort(hashes)
        place = order.tolist()
        words, hashes = [words[i] for i in place], hashes[order]
        own, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        own_at = np.cumsum(sizes) - sizes
        bounds = np.searchsorted(part_of(hashes, self.bits), np.arange((1 << self.bits) + 1)).tolist()
        found: list[bytes | None] = [None] * len(words)
        for part, files in self.parts.items():
            lo, hi = bounds[part], bounds[part + 1]
            for name in files if hi > lo else ():
                stored, text_at, ids_at, text, ids = (np.asarray(array(self.folder, name, key)) for key in ("hash", "word_at", "ids_at", "word", "ids"))
                index, at = np.arange(lo, hi), np.searchsorted(stored, hashes[lo:hi])
                while len(index):
                    index, at = index[inside := at < len(stored)], at[inside]
                    index, at = index[same := stored[at] == hashes[index]], at[same]
                    equal = text_at[at + 1] - text_at[at] == sizes[index]
                    i, k = index[equal], at[equal]
                    if len(i):
                        theirs, begin = gathered(text, text_at[k], sizes[i])
                        right = np.logical_and.reduceat(theirs == gathered(own, own_at[i], sizes[i])[0], begin[:-1])  # no word is empty
                        equal[equal] = right
                        i, k = i[right], k[right]
                        packed, ends = gathered(ids, ids_at[k], ids_at[k + 1] - ids_at[k])
                        packed, ends = packed.tobytes(), ends.tolist()
                        for one, first, last in zip(i.tolist(), ends[:-1], ends[1:], strict=True):
                            found[place[one]] = packed[first:last]
                    index, at = index[~equal], at[~equal] + 1  # another word of the same hash
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split_texts = [PIECES.findall(text or "") for text in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = set().union(*split_texts).difference(self.known)
        single = [piece for piece in new if one_word(piece)]  # words as they are, so their ids need no table of words
        several = {piece: [w.encode() for w in self.split(piece)] for piece in new.difference(single)}
        words = [piece.encode() for piece in single]
        others = list({w for split in several.values() for w in split})
        ids = self.look_up(words + others)
        self.known.update(zip(single, ids, strict=False))
        of_word = dict(zip(others, ids[len(words) :], strict=True))
        self.known.update((piece, b"".join([of_word[w] for w in split])) for piece, split in several.items())
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split_texts]


@functools.lru_cache(maxsize=1)
def text_encoder(folder: str, pattern: str, names: tuple, bits: int) -> TextEncoder:
    return TextEncoder(folder, pattern, names, bits)


def encode_texts(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, ids_le binary (uint32, little-endian) of every whole text.

    Null and empty texts have no ids; a word of any length is folded whole; rows that repeat are encoded
    alike; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared.new_folder(spark, "bpe-words")
    words = shared.written(distinct_words(docs, pattern), "bpe-distinct")
    word_bits = max(LEAST_BITS, math.ceil(math.log2(max(words.count(), 1) / PART_WORDS)))
    index: dict[int, list[str]] = {}
    for row in write_dictionary(words, read_ranks(ranks_file), folder, word_bits).collect():  # names of some files per part, no data
        index.setdefault(row.part, []).append(row.name)
    shared.discard(words)
    names = tuple((part, tuple(files)) for part, files in sorted(index.items()))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(folder, pattern, names, word_bits)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                few = batch.slice(begin, 500)
                ids = encoder.encode(few.column(1).to_pylist())
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([few.column(0), lists, pa.array(ids, pa.binary())], ["doc_id", "ids", "ids_le"])

    return docs.select("doc_id", "text").mapInArrow(assemble, "doc_id long, ids array<int>, ids_le binary")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_texts(shared.documents(spark, sf_dir), file, public_tokenizers.PATTERN)
    decoded = Ranks(read_ranks(file)).decode(F.col("ids"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")
    )


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
