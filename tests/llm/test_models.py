"""The fitted operators: results follow from the distinct texts, and one training step against sums written out by hand."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.llm import language_id, quality_classifier

GOOD = [f"the {a} {b} walked along the quiet river while {c} told a long story about winters in the {a} hills and nobody minded" for a in ("old", "young", "tall") for b in ("farmer", "teacher", "sailor") for c in ("she", "he", "they")]
JUNK = [f"{w} {w} {w} " * 25 + f"$$$ ### {k}" for k, w in enumerate(("buy", "cheap", "win", "click"))] + ["###$$$ %%% &&& *** " * 20 + str(k) for k in range(4)]
TEXTS = {
    "en": [f"the house on the {x} is old and the people are kind" for x in ("hill", "road", "river", "coast", "lake", "farm")],
    "de": [f"das Haus an der {x} ist alt und die Leute sind freundlich" for x in ("Straße", "Brücke", "Küste", "Mauer", "Ecke", "Kirche")],
    "fr": [f"la maison près de la {x} est vieille et les gens sont aimables" for x in ("rivière", "gare", "plage", "forêt", "ville", "place")],
}


def copies(df, n):
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("copy")


def test_quality_of_copies(spark):
    """A table, and the table with every row many times, are judged alike."""
    df = spark.createDataFrame([(t,) for t in GOOD + JUNK], "text string").repartition(4)
    want = None
    for n in (1, 100, 3000):
        scored = copies(df, n).select("text", quality_classifier.quality_score(copies(df, n)).alias("s")).groupBy("text").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("s").alias("n"))
        got = {r.text: (r.low, r.high) for r in scored.collect() if r.n == n}
        assert len(got) == len(set(GOOD + JUNK)) and all(a == b for a, b in got.values())
        assert all(got[t][0] >= 0.5 for t in GOOD) and all(got[t][0] < 0.5 for t in JUNK)
        want = want or got
        assert got == want


def test_languages_of_copies(spark):
    """Copies of one text take no other text's place in the sample, and no language is lost."""
    df = spark.createDataFrame([(x, t) for x, texts in TEXTS.items() for t in texts], "lang string, text string").repartition(4)
    junk = spark.createDataFrame([("en", "the the the"), ("en", "an an an")], "lang string, text string")
    for n, m in ((1, 1), (100, 1), (1, 20_000)):
        rows = copies(df, n).unionByName(copies(junk, m))
        model = language_id.train(rows, rows_per_language=8)
        assert model.languages == ["de", "en", "fr"]
        got = language_id.predict(df.select(F.xxhash64("text").alias("doc_id"), "text", "lang"), model, "doc_id", "text", F.col("lang"))
        assert got.filter("lang = lang_pred").count() == 18
    again = [language_id.train(copies(df, n), rows_per_language=4) for n in (1, 50)]
    assert (again[0].weights == again[1].weights).all() and again[0].temperature == again[1].temperature


def test_votes_know_no_length():
    """Junk and prose are judged alike at any length; a few words are not called bad."""
    texts = [" ".join([t] * n) for n in (1, 10, 400) for t in ("spam deal spam deal spam deal spam deal spam deal spam deal spam deal " * 6,)]
    bad = quality_classifier.votes(quality_classifier.shares(pa.array(texts, pa.large_string()))[0])
    assert (bad[:, quality_classifier.LABELLERS.index("few_words")] == quality_classifier.BAD).all() and (bad[0] == bad[1]).all()
    few = quality_classifier.votes(quality_classifier.shares(pa.array(["a a", "!", "OK", "x $ y"], pa.large_string()))[0])
    assert not (few[:, quality_classifier.LABELLERS.index("few_words")] == quality_classifier.BAD).any()
    rng = np.random.default_rng(1)
    prose = " ".join(f"w{k}" for k in rng.zipf(1.3, 40_000))
    assert quality_classifier.votes(quality_classifier.shares(pa.array([prose], pa.large_string()))[0])[0, quality_classifier.LABELLERS.index("few_words")] != quality_classifier.BAD


def test_quality_fit_by_hand():
    """One step of the scorer's AdaGrad, document by document."""
    texts, target = ["aa bb bb", "cc", "bb ! dd"], np.array([1.0, 0.0, 0.5])
    array = pa.array(texts, pa.large_string())
    got = quality_classifier.fit([array], target, epochs=1)
    bins, buckets, row, code = quality_classifier.hashed(array)
    w, seen = {}, {}
    for _ in range(100):  # small samples are gone through 100 times
        grad = {}
        for d, y in enumerate(target):
            mine = [code[k] for k in range(len(row)) if row[k] == d]
            uses = [(b, 1.0) for b in bins[d]] + [(b, 1 / len(mine)) for k in mine for b in buckets[k]]
            error = 1 / (1 + math.exp(-sum(w.get(b, 0.0) * x for b, x in uses))) - y
            for b, x in uses:
                grad[b] = grad.get(b, 0.0) + error * x / 3
        for b, g in grad.items():
            seen[b] = seen.get(b, 1e-8) + g * g
            w[b] = w.get(b, 0.0) - 0.3 * g / math.sqrt(seen[b])
    assert set(np.flatnonzero(got)) <= set(w)
    for b, x in w.items():
        assert got[b] == pytest.approx(x, rel=1e-4, abs=1e-5)
