import numpy as np

from lotwise.llm import bpe, hash_store


def test_words_are_looked_up_in_their_order(tmp_path):
    """Each piece that is one word passed through a set, a table of words and a table of pieces; ids now come in the order of the words."""
    words = sorted([b"ab", b" word", b"x,", "é".encode()], key=bpe.spark_hash)
    at = np.append(0, np.cumsum([len(w) for w in words]))
    name = hash_store.write_part(f"file://{tmp_path}", {
        "hash": np.array([bpe.spark_hash(w) for w in words], np.uint64), "word_at": at, "word": np.frombuffer(b"".join(words), np.uint8),
        "ids_at": np.arange(5) * 4, "ids": np.arange(4, dtype="<u4").view(np.uint8),
    })
    encoder = bpe.TextEncoder(f"file://{tmp_path}", r"\S+", tuple((part, (name,)) for part in range(32)), 5)
    ids = {w: np.uint32(k).tobytes() for k, w in enumerate(words)}
    asked = [b"zz", *words[::-1], words[0]]
    assert encoder.look_up(asked) == [ids.get(w) for w in asked] and encoder.look_up([]) == []
