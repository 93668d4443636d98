"""The toxicity fit and its scores read the same words, and long texts give way to others in the sample."""

from fairline.llm import toxic_crf


def test_long_words_are_scored():
    texts = [("red green moron blue " if k % 4 == 0 else "red green house blue ") * 8 for k in range(80)]
    model = toxic_crf.fit(texts, [int(k % 4 == 0) for k in range(80)], {0: 60.0, 1: 20.0})
    plain, marked = "moron", "moron" + "!" * 300
    assert toxic_crf.slots(plain.encode())[0] == toxic_crf.slots(marked.encode())[0]
    known, long = model.emissions(plain)[0], model.emissions(marked)[0]
    assert long > model.unseen and long == known


def test_long_texts_are_replaced_in_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 50 if k < 30 else f"short {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxic_crf, "SAMPLE_CHARS", 20)
    monkeypatch.setattr(toxic_crf, "fit", lambda rows, toxic, shares: (rows, toxic))
    rows, toxic = toxic_crf.train(docs, labels, sample={1: 8, 0: 8})
    assert len(rows) == 16 and sum(toxic) == 8 and all(t.startswith("short") for t in rows)
