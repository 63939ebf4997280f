import json

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from lotwise.llm import tokenize

JSON = path("byte_bpe_50k.json")
WORDS = ["Any", " word", "s", " s", " élève", "ÿÖÀ", " " + "xq" * 300, " straße", "don", "Ø"]


def test_words_of_letters_are_encoded_by_the_model_alone(monkeypatch):
    """Two thirds of op1's and op2's work was the library's steps before the model, some 12 microseconds for each distinct word of letters."""
    library = Tokenizer.from_file(JSON)
    one = tokenize.word_encoder(library, lambda piece: b"whole")
    assert [one(w) for w in WORDS] == [tokenize.packed(library.encode(w, add_special_tokens=False).ids) for w in WORDS]
    assert {one(p) for p in (" ", "a1", "a.", "'s", " #", "ř", "a b")} == {b"whole"}


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_other_steps_leave_words_to_the_whole_library(change):
    library = Tokenizer.from_str(json.dumps(json.loads(Tokenizer.from_file(JSON).to_str()) | change))
    assert {tokenize.word_encoder(library, lambda piece: b"whole")(w) for w in WORDS} == {b"whole"}
