from collections import Counter

from lotwise.llm import kneser_ney


def test_words_are_counted_through_their_ngrams(spark):
    """The words' own counts went through the shuffle of all tokens beside the n-grams (disk 4.34 times the input at 30 GB)."""
    texts = ["a b a b a c", "b a", "", None, "zz a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.kind for r in kneser_ney.count_grams(docs, 2, 4).select("kind").collect()} == {"gram"}
    counts = Counter(w for t in texts for w in [*(t or "").split(), "<end>"])
    for order in (2, 3):
        model = kneser_ney.fit(docs, order)
        assert (model.tokens, model.words) == (sum(counts.values()), len(counts))
        for r in kneser_ney.score_documents(docs.filter("doc_id = 4"), model).collect():
            assert r.n_known == 3
        tokens = kneser_ney.np.array([kneser_ney.shared.word_hash[w.encode()] for w in counts if w != "<end>"] + [kneser_ney.END], "uint64")
        known = model.find("gram1", kneser_ney.gram_hash([tokens]), 2)[1]
        assert known.tolist() == [counts[w] for w in counts if w != "<end>"] + [counts["<end>"]]
