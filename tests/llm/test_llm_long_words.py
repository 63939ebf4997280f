"""Long words of byte-level BPE: windows joined at common tokens give the ids of the plain fold."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lotwise.llm import bpe


def plain_fold(word, ranks):
    pieces = [word[k : k + 1] for k in range(len(word))]
    while True:
        pairs = [(ranks.get(a + b, 10**9), k) for k, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))]
        if not pairs or min(pairs)[0] == 10**9:
            return [ranks[p] for p in pieces]
        k = min(pairs)[1]
        pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]


@pytest.fixture(scope="module")
def toy():
    """Merges learnt from a few bytes, so that tokens of up to a dozen bytes arise, also of repeats."""
    rng = random.Random(5)
    text = [b"a", b"b"] + [rng.choice([b"a", b"b", b"c", b"-"]) for _ in range(3000)] + [b"-"] * 400 + [b"a"] * 200
    ranks = {bytes([k]): k for k in range(256)}
    for _ in range(60):
        pair = next(p for p, _ in Counter(zip(text, text[1:], strict=False)).most_common() if b"".join(p) not in ranks)
        joined, out, k = b"".join(pair), [], 0
        ranks[joined] = len(ranks)
        while k < len(text):
            out.append(joined if tuple(text[k : k + 2]) == pair else text[k])
            k += 2 if tuple(text[k : k + 2]) == pair else 1
        text = out
    assert bpe.all_reached(ranks) and max(map(len, ranks)) > 7
    return ranks


def test_ranks_with_a_token_out_of_reach(spark, monkeypatch):
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"bcd": 259}
    ranks[b"cabd"] = 260
    assert not bpe.all_reached(ranks)
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    words = [b"abcdabd" * 20, b"cabd", b"xcabdx" * 9]
    found = folded(spark, words, ranks)
    assert all(found[k] == (plain_fold(w, ranks) if w not in ranks else [ranks[w]]) for k, w in enumerate(words))


def folded(spark, words, ranks, window=None):
    own = bpe.Ranks(ranks)
    if window:
        own.fold = lambda word: own.fold_windows(word, window)
    frame = spark.createDataFrame([(k, bytearray(w)) for k, w in enumerate(words)], "k int, word binary").repartition(4)
    return {r.k: r.ids for r in frame.select("k", own.encode(F.col("word")).alias("ids")).collect()}


@pytest.mark.parametrize("window", [4, 7, 48])
def test_windows_of_any_size(spark, toy, window):
    """Windows shorter than a token make joins fail, so that windows grow, up to the whole word."""
    rng = random.Random(window)
    words = ["".join(rng.choice("abc-") for _ in range(rng.randrange(1, 160))).encode() for _ in range(60)]
    words += [b"-" * n for n in (1, 2, 47, 48, 49, 150)] + [b"a" * 131, b"ab" * 60, b"xyz" * 30, b"-" * 60 + b"q" + b"a" * 60]
    found = folded(spark, words, toy, window)
    assert all(found[k] == plain_fold(w, toy) for k, w in enumerate(words))


def test_words_of_a_million_bytes(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = [b"-" * 1_000_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(64_000)).encode(), ("äöü" * 4000 + "é😀" * 3000).encode()]
    found = folded(spark, words, ranks)
    assert all(found[k] == library._encode_single_piece(w) for k, w in enumerate(words))
