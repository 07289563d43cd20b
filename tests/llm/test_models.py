"""Held-out accuracy of the trained operators."""

import os

import pytest

from molweave.llm import langid, toxicity
from molweave.llm.queries import table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_language_of_held_out_documents(spark):
    documents = table(spark, SF, "documents")
    rows = langid.detect(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_language_predictions_ignore_other_columns(spark):
    documents = table(spark, SF, "documents").limit(200)
    model = langid.fit(table(spark, SF, "documents"))
    first = {r.doc_id: r.lang_pred for r in langid.predict_languages(documents.select("doc_id", "text"), model).collect()}
    changed = documents.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source")
    assert first == {r.doc_id: r.lang_pred for r in langid.predict_languages(changed, model).collect()}


def test_toxic_documents(spark):
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").collect()
    clean, toxic = ([r for r in rows if r.toxic == y] for y in (0, 1))
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    english = [r for r in toxic if r.n_hits > 0]
    assert english and sum(r.predicted for r in english) >= 0.9 * len(english)


@pytest.mark.parametrize("sf,floor", [("sf0.01", 0.7), ("sf0.1", 0.9)])
def test_recall_of_all_held_out_toxic_documents(spark, sf, floor):
    """Those without a hit count too."""
    folder = f"/root/testdata/{sf}"
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = toxicity.toxicity(documents, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert toxic and sum(toxic) >= floor * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_label_model_finds_accurate_voters():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    rates = [(0.9, 0.02), (0.8, 0.05), (0.7, 0.05), (0.6, 0.5)]
    fired = np.stack([np.where(truth, rng.random(4000) < a, rng.random(4000) < b) for a, b in rates], axis=1)
    votes = np.where(fired, 1, 0)
    votes = np.concatenate([votes, votes[:, -1:], votes[:, -1:]], axis=1)  # two voters that copy the useless one
    posterior = toxicity.label_model(votes, np.ones(4000), 0.2)
    assert ((posterior > 0.5) == truth).mean() > 0.95


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F

    from molweave.llm.folds import held_out

    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(documents, x).collect()} for x in (labels, flipped))
    assert one == two


def test_parts_of_a_long_text_count_each_subword_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    scores = rng.normal(size=(1 << langid.BUCKET_BITS, 3))
    model = langid.Model(["a", "b", "c"], scores, np.zeros(3), 1.0, np.zeros(3))
    long = " ".join("".join(rng.choice(list("abcdé"), 7)) for _ in range(5000))
    texts = pa.array(["ab cd", long, None, "", long[:64], long[:65], "x"])
    whole, n_whole = model.means(texts)
    for size in (64, 1000, 4097):
        monkeypatch.setattr(langid, "SEGMENT", size)
        parts, n_parts = model.means(texts)
        assert (n_parts == n_whole).all() and np.allclose(parts, whole, atol=1e-12)


def test_every_feature_with_enough_evidence_is_mined(spark):
    import random

    draw, words = random.Random(3), [f"w{k:05d}" for k in range(6000)]
    rows = []
    for _ in range(6):
        draw.shuffle(words)
        rows.append((" ".join(words), 1))
    rows += [("nothing of the kind is said here", 0)] * 3
    sample = spark.createDataFrame(rows, "text string, toxic long")
    mined = toxicity.mine(sample, {0: 1.0, 1: 1.0})
    hashes = set(toxicity.Words(toxicity.pa.array(words)).hash.view("int64").tolist())
    assert hashes <= {f for f, _ in mined}
