import numpy as np

from lotwise.llm import bpe, hash_store


def test_words_of_one_hash_are_told_apart(tmp_path, monkeypatch):
    """The lookup compares whole arrays of words, so words that share a hash, of one length or not, must still get their own ids."""
    monkeypatch.setattr(bpe, "spark_hash", lambda word: len(word) // 3)
    words, ids = [b"a", b"bb", b"ab", b"cccc", b"ccdc"], [[1], [2, 3], [4], [5, 6, 7], []]
    folder = f"file://{tmp_path}"
    bounds = lambda runs, width: np.append(0, np.cumsum([len(r) * width for r in runs]))
    name = hash_store.write_part(folder, {
        "hash": np.array([0, 0, 0, 1, 1], np.uint64), "word_at": bounds(words, 1), "word": np.frombuffer(b"".join(words), np.uint8),
        "ids_at": bounds(ids, 4), "ids": np.concatenate([np.array(i, "<u4") for i in ids]).view(np.uint8),
    })
    encoder = bpe.TextEncoder(folder, r"\S+", ((0, (name,)),), 5)
    wanted = {w: np.array(i, "<u4").tobytes() for w, i in zip(words, ids, strict=True)}
    assert encoder.word_ids(words[::-1]) == wanted and encoder.word_ids([b"zz"]) == {} and encoder.word_ids([]) == {}
    assert [bytes(x) for x in encoder.encode(["ab", "cccc", None])] == [wanted[b"ab"], wanted[b"cccc"], b""]
