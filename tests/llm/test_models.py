"""Toxicity and language ID on held-out rows, and their odd cases."""

import random

import numpy as np
import pytest

from lintel.llm import langid, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "scum"])
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model, keep=["doc_id"]).collect()
    from zlib import crc32

    held = [r for r in got if crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = np.mean([(r["score"] >= toxicity.CUT) == (r["doc_id"] % 4 == 0) for r in held])
    assert len(got) == 600 and len(held) > 100 and right > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_learns_from_no_held_out_label(labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.embed, b.embed) and a.cut == b.cut


def test_whole_texts_are_scored_in_pieces():
    model = toxicity._untrained(np.random.default_rng(0))
    score = toxicity.scorer(model)
    words = [f"w{k % 977}" for k in range(45_000)]
    feats = [np.array([toxicity.word_features(w) for w in words])]
    want = model.scaled(model.probability(toxicity._forward(model, *toxicity._flat(feats))[0]))
    assert np.allclose(score([" ".join(words)]), want, atol=1e-4)


def test_toxicity_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(1, None), (3, 7)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels) is None
    out = toxicity.score_documents(odd, None)
    assert out.count() == odd.count() and out.where("score <> 0").count() == 0
    model = toxicity._untrained(np.random.default_rng(0))
    assert toxicity.score_documents(odd, model, keep=["doc_id"]).where("score is null").count() == 0
    assert toxicity.score_documents(nothing, model).count() == 0


LANGS = {"en": "the of and to that with this have from they".split(), "fr": "le les des une dans être château garçon où très".split(), "de": "der die und nicht über straße schön für wird ein".split()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(LANGS[name]) for _ in range(rng.randrange(4, 40))), name) for k in range(450) for name in [sorted(LANGS)[k % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_held_out_rows(spoken):
    from zlib import crc32

    got = {r["doc_id"]: r for r in langid.identify(spoken, langid.fit(spoken)).collect()}
    held = [r for r in spoken.collect() if crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(got) == 450 and held and all(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)


def test_mixture_finds_both_languages(spoken):
    model = langid.fit(spoken)
    words = LANGS["en"] * 7 + LANGS["de"] * 3
    ids, starts = langid.grams(words)
    pi = dict(zip(model.languages, langid.infer(np.add.reduceat(model.loglik[ids].sum(axis=1), starts, axis=0)), strict=True))
    assert abs(pi["en"] - 0.7) < 0.1 and abs(pi["de"] - 0.3) < 0.1 and pi["fr"] < 0.05


def test_language_odd_rows(odd, spoken, nothing, spark):
    model = langid.fit(spoken)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 _ !"), (None, "the of"), (4, "the " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en" and got[4][0] == "en"
    assert langid.fit(nothing) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0
