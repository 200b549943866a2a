"""Toxicity: recall and precision of toxic texts held out, and the linear classifier against its definition."""

import os

import numpy as np
import pytest

from gridloom.llm import toxicity


@pytest.mark.parametrize("sf,recall,precision", [("sf0.01", 0.5, 0.9), ("sf0.1", 0.9, 0.95)])
def test_held_out(spark, sf, recall, precision):
    """A classifier that marks nothing fails both."""
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("no tables")
    rows = toxicity.op7_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    found = [r for r in rows if r["predicted"] == 1]
    right = sum(r["toxic"] == 1 for r in found)
    assert right / sum(r["toxic"] == 1 for r in rows) >= recall and right / len(found) >= precision


def test_score_is_the_sum_of_distinct_features(spark):
    rng = np.random.default_rng(4)
    texts = ["Bad, bad text!", "bad BAD bad", "", None, "longerword longerwords longer", "x " * 5000 + "bad"]
    table = np.where(rng.random(1 << toxicity.BITS) < 0.5, rng.normal(0, 1, 1 << toxicity.BITS), 0).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, table, -0.25).collect()}
    for i, text in enumerate(texts):
        fams = toxicity._families(toxicity.distinct_features([text])["feats"][0])
        want = 1 / (1 + np.exp(0.25 - table[toxicity._slots(fams)].sum(dtype=np.float64)))
        assert got[i] == pytest.approx(want, abs=1e-5)
    words = {"bad", "text"}  # the same by hand: a word's own features once each, however often it stands there
    one = toxicity._families(toxicity.distinct_features([texts[0]])["feats"][0])
    assert len(one[0]) == len(words)


def test_rare_class_is_learned():
    """Two words mark the rare class; chance features and the bias don't drown them."""
    rng = np.random.default_rng(7)
    target = (np.arange(600) % 15 == 0).astype(float)
    slots = [np.unique(np.concatenate((rng.integers(100, 5000, 60), [1 + int(rng.integers(2))] if y else []))).astype(np.int64) for y in target]
    table, bias = toxicity.fit_linear(slots, target)
    score = np.array([table[s].sum() + bias for s in slots])
    assert np.array_equal(score > 0, target > 0.5)
    assert toxicity.fit_linear(slots, np.zeros(600))[0].any() == toxicity.fit_linear([], np.zeros(0))[0].any() == False  # noqa: E712


def test_fit_is_a_minimum():
    """The weights are those of the penalised logistic loss: any small change makes it larger."""
    rng = np.random.default_rng(1)
    target = rng.random(80).round(2)
    slots = [np.unique(rng.integers(0, 12, 5)) for _ in range(80)]
    table, bias = toxicity.fit_linear(slots, target, ridge=2.0, least=0.0, steps=4000)
    ones = target.sum()
    n = np.bincount(np.concatenate(slots), minlength=12)
    inside = np.array([sum(t for s, t in zip(slots, target) if f in s) for f in range(12)])
    odds = np.log((inside + 1) / (ones + 2)) - np.log((n - inside + 1) / (80 - ones + 2))
    heavy = 1 + (np.sqrt((80 - ones) / ones) - 1) * target

    def loss(w, b):
        z = np.array([(w * odds)[s].sum() + b for s in slots])
        return (heavy * (np.logaddexp(0, z) - target * z)).sum() + (w**2).sum()

    w = table[:12] / odds
    base = loss(w, bias)
    for k in range(12):
        for d in (0.02, -0.02):
            assert loss(w + d * (np.arange(12) == k), bias) > base - 1e-3
    assert loss(w, bias + 0.02) > base - 1e-3 and loss(w, bias - 0.02) > base - 1e-3
