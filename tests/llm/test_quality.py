"""Ordinal regression: gradient, order of thresholds, held-out accuracy, awkward rows."""

import math
import re
import zlib

import numpy as np
import pytest

from conftest import SMALL
from llm_cases import awkward_rows, clashing, docs
from millrun.llm import quality, queries


def test_recovers_an_ordinal_model():
    rng = np.random.default_rng(0)
    true = rng.normal(0, 2, 30)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(4000)]
    score = np.array([true[r].sum() for r in rows]) + rng.logistic(size=4000)
    grades = np.digitize(score, [-1.0, 0.5, 2.0])
    model = quality.fit_ordinal([r.astype(np.int32) for r in rows], grades, dimensions=64)
    assert (np.diff(model.thresholds) > 0).all()
    assert np.corrcoef(model.weights[:30], true)[0, 1] > 0.97
    p = np.array([model.at_least(r) for r in rows])
    assert (np.diff(p, axis=1) <= 0).all()
    for k in range(3):
        assert abs(p[:, k].mean() - (grades > k).mean()) < 0.02


def test_one_grade_gives_no_model():
    assert quality.fit_ordinal([np.array([1])] * 5, np.ones(5, dtype=int)) is None


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    ratings = quality.graded(spark.read.parquet(f"{sf}/labels.parquet")).cache()
    model = quality.fit(documents, ratings.where("xxhash64(id) % 4 <> 0"))
    scored = quality.with_grades(documents, model, "text", "g")
    held = scored.join(ratings.where("xxhash64(id) % 4 = 0"), scored["doc_id"] == ratings["id"])
    rows = held.selectExpr("grade", "g.top >= 0.5 as kept", "g.expected as e").collect()
    assert len(rows) > 60
    clean = [r["kept"] for r in rows if r["grade"] == 2]
    poor = [r["kept"] for r in rows if r["grade"] == 0]
    assert np.mean(clean) >= 0.95
    assert np.mean(poor) <= 0.2
    assert np.mean([r["e"] for r in rows if r["grade"] == 2]) > np.mean(
        [r["e"] for r in rows if r["grade"] < 2]) + 0.5


def plain_score(text, weights):
    """Sum of the weights of a text's features, from their definition."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", raw.translate(bytes(
        c + 32 if 65 <= c <= 90 else c for c in range(256)))) if w]
    names = {zlib.crc32(re.sub(rb"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", b"", w)) for w in words}
    kinds = [rb"[A-Z]", rb"[0-9]", rb"!", rb"\|", rb"[#*$%&<>]", rb'[@:/="_]', rb"\n", rb"[.,;?'()]"]
    for i, kind in enumerate(kinds):
        share = len(re.findall(kind, raw)) / max(1, len(raw))
        level = 0 if not share else max(1, 10 + math.ceil(math.log2(share)))
        names.add(zlib.crc32(b"class", i * 64 + level + 1))
    names.add(zlib.crc32(b"fresh", int(10 * len(set(words)) / max(1, len(words))) + 1))
    names.add(zlib.crc32(b"words", min(16, len(words)).bit_length() + 1))
    return sum(float(weights[f]) for f in {h % quality.DIMENSIONS for h in names})


def test_whole_table(spark):
    """Scores of all documents against plain Python with the fitted weights and thresholds."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(documents, quality.graded(spark.read.parquet(f"{SMALL}/labels.parquet")))
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = queries.op2_quality_classifier(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        score = plain_score(texts[r["doc_id"]], model.weights)
        p = [1 / (1 + math.exp(cut - score)) for cut in model.thresholds]
        assert r["p_top"] == pytest.approx(p[-1], abs=1e-5)
        assert r["expected_grade"] == pytest.approx(sum(p), abs=1e-5)
        assert r["kept"] == (r["p_top"] >= 0.5)


def test_the_fit_is_the_most_likely(spark):
    """No small step in a weight or threshold makes the penalised likelihood better by much."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(800)]
    true = rng.normal(0, 1.5, 12)
    grades = np.digitize([true[r].sum() + rng.logistic() for r in rows], [-0.5, 1.0])
    model = quality.fit_ordinal(rows, grades, dimensions=16)

    def loss(weights, cuts):
        total = 0.5 * sum(w * w for w in weights)
        for r, g in zip(rows, grades):
            s = weights[r].sum()
            up = [1.0, *(1 / (1 + np.exp(c - s)) for c in cuts), 0.0]
            total -= np.log(up[g] - up[g + 1])
        return total / len(rows)
    best = loss(model.weights.astype(float), model.thresholds)
    for k in range(12):
        for step in (-0.05, 0.05):
            moved = model.weights.astype(float)
            moved[k] += step
            assert loss(moved, model.thresholds) > best - 1e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            cuts = model.thresholds.copy()
            cuts[k] += step
            assert loss(model.weights.astype(float), cuts) > best - 1e-4


def test_grades(spark):
    labels = spark.createDataFrame(
        [(1, 0, 0), (1, 1, 0), (2, 1, 1), (3, 1, 0), (4, None, 0), (None, 1, 0), (5, 0, None)],
        "doc_id bigint, quality int, toxic int")
    got = {r["id"]: r["grade"] for r in quality.graded(labels).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 5: 0}


def test_awkward_rows(spark):
    df = clashing(docs(spark, awkward_rows()))
    ratings = spark.createDataFrame([(0, 0), (1, 0), (4, 2), (5, 2), (6, 2), (9, 1), (77, 1)],
                                    "id bigint, grade int")
    assert quality.classify(df, ratings).count() == len(awkward_rows())
    kept = quality.keep_top(df, ratings)
    assert kept.columns == df.columns and kept.count() <= len(awkward_rows())
    unrated = quality.classify(df, ratings.limit(0)).collect()
    assert all(r["kept"] and r["p_top"] is None for r in unrated)
    assert quality.classify(docs(spark, []), ratings).count() == 0


def test_training_rows_are_bounded(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    ratings = quality.graded(spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert quality.fit(documents, ratings, max_labelled=40) is not None
