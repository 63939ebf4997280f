import pyarrow as pa

from lotwise.llm import near_dup, shared


def test_workers_hold_few_texts_at_once():
    """Whole batches of 10,000 texts became Python strings, and a worker kept 400,000 words from stage to stage."""
    texts = [None, *(f"a b c d e {k}" for k in range(1_199))]
    ids = pa.array(range(1_200), pa.int64())
    whole = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["node", "block", "size", "text"])
    parts = list(near_dup.packed_grams(iter([whole]), 5))
    assert [p.num_rows for p in parts] == [500, 500, 200]
    rows = pa.Table.from_batches(parts).to_pydict()
    assert rows["node"] == ids.to_pylist() and rows["grams"] == [near_dup.ngram_hashes(t, 5).tobytes() for t in texts]
    assert shared.word_hash.limit <= 100_000
