"""Whole-text encoding with a byte-level BPE file of the tokenizers library.

Byte-level BPE never merges across pre-tokens, so a text may be cut at places that always are
pre-token bounds, each piece encoded by the library once per worker, and the ids joined. A piece
is a word with its leading space, or any other run up to white space. This does the library's
work once per distinct piece instead of once per occurrence. As the library does by default, the string
of a special token in a text becomes that token, so a text that holds one is cut there first.
A word of letters is one pre-token, so the library's model takes it as it is, without the steps before it.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Callable

from .shared import BoundedCache

#: White space and letters of Unicode's Latin-1 block, as the pre-tokeniser sees them.
SPACES = "\t-\r \x85\xa0  -     　"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"

PIECES = re.compile(f" ?[{LETTERS}]++(?![^{SPACES},.;:!?])| ?[^{SPACES}]++|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, all others for characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip([*_SHOWN, *(b for b in range(256) if b not in _SHOWN)], map(chr, [*_SHOWN, *range(256, 512 - len(_SHOWN))]), strict=True))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_encoder(tokenizer, whole: Callable[[str], bytes]) -> Callable[[str], bytes]:
    """``whole`` for a piece that holds no added token, but words of letters go to the model alone where the file's settings say that nothing else touches them."""
    steps = json.loads(tokenizer.to_str())
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if steps["normalizer"] or not plain.items() <= (steps["pre_tokenizer"] or {}).items() or any(steps[k] for k in ("truncation", "padding")):
        return whole
    model, is_word = tokenizer.model, re.compile(f" ?[{LETTERS}]+").fullmatch
    return lambda piece: packed([t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))]) if is_word(piece) else whole(piece)


@functools.lru_cache(maxsize=4)
def tokenizer_of(tokenizer_file: str):
    """Cache of piece -> ids as little-endian unsigned 32-bit bytes, the same for a whole text, and the strings of added tokens; one per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    added = tuple(token.content for token in tokenizer.get_added_tokens_decoder().values())
    whole = lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)
    return BoundedCache(word_encoder(tokenizer, whole), 1_000_000), whole, added


def encode(text: str | None, tokenizer_file: str) -> bytes:
    """The ids of a whole text, little-endian unsigned 32-bit; null is empty."""
    pieces, whole, added = tokenizer_of(tokenizer_file)
    text = text or ""
    if any(string in text for string in added):
        return whole(text)  # rare: the library cuts the whole text itself
    return b"".join(map(pieces.__getitem__, PIECES.findall(text)))
