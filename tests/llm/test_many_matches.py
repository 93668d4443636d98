"""Texts with very many places, null texts in the fits, and fits that run in a task."""

import pytest

from fairline.llm import license_rules, toxic_crf, weak_quality


@pytest.mark.parametrize("n", [1, 255, 256, 257, 512, 100_000])
def test_places_of_very_many_matches(spark, n):
    """Folding in blocks gives the places one by one, also at the edges of a block."""
    row = spark.createDataFrame([(1, "x " + "cc by y " * n)], "doc_id long, text string")
    got = license_rules.scan(row).first()
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (1 + 3 * n, n, 1, 3 * n - 2)
    assert [(d["first"], d["last"]) for d in got["detections"]] == [(1 + 3 * k, 3 + 3 * k) for k in range(n)]


def test_keywords_inside_others_run_all_their_rules(spark):
    row = spark.createDataFrame([(1, "released under the GNU Lesser General Public License version 2.1, CC BY SA 4.0")], "doc_id long, text string")
    got = license_rules.scan(row).first()
    assert got["labels"] == "cc-by,cc-by-sa,gpl,lgpl-2.1" and got["base_labels"] == "cc-by,gpl" and got["n_base"] == 2


def test_null_texts_enter_the_samples(spark, monkeypatch):
    docs = spark.createDataFrame([(k, None if k % 2 else f"word {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 4 // 2) for k in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxic_crf, "fit", lambda rows, toxic, shares: (rows, toxic))
    rows, toxic = toxic_crf.train(docs, labels, sample={1: 100, 0: 100})
    assert rows.count("") > 0 and len(rows) == len(toxic)
    seen = []
    monkeypatch.setattr(weak_quality, "fit", lambda rows, goal: seen.append(rows))
    weak_quality.train(docs)
    assert seen[0].count("") == 20


def test_sample_is_the_lowest_hashes(spark, monkeypatch):
    """Narrowing a class before the sort takes the rows that sorting all of it takes."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('t', id) as text")
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(toxic_crf, "fit", lambda rows, toxic, shares: (rows, toxic))
    rows, _ = toxic_crf.train(docs, labels, sample={1: 50, 0: 50})
    left = labels.filter(~toxic_crf.held_out("doc_id", 5, 0)).selectExpr("doc_id", "toxic", "xxhash64(doc_id) as h")
    want = [f"t{r[0]}" for t in (0, 1) for r in left.filter(f"toxic = {t}").orderBy("h").limit(50).collect()]
    assert sorted(rows) == sorted(want)
