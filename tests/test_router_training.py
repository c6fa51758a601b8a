"""Weights fitted over tables, against MLlib's on the driver."""

import numpy as np
import pytest

from parchment.operators import router, router_training
from tests.test_router import TEXTS


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, label, t) for i, (label, t) in enumerate((k, t) for k, v in TEXTS.items() for t in v)]
    # A copy, a text without shared terms and one without any.
    rows += [(90, "qa", "What is the cap?"), (91, "summary", "zygote quorum"), (92, "extract", "?")]
    return spark.createDataFrame(rows, "key int, label string, text string")


def test_spread_training_reaches_the_local_optimum(texts, monkeypatch):
    local = router.train(texts, "key", "label")
    expected = {r.key: r for r in local.predict(texts, "key").collect()}

    def refused(*args, **kwargs):
        raise AssertionError("the weights went through the driver")

    monkeypatch.setattr(router, "LogisticRegression", refused)
    spread = router.train(texts, "key", "label", iterations=30, local_weights=0)
    assert list(spread.intercepts) == list(local.intercepts)
    for r in spread.predict(texts, "key").collect():
        for c in local.intercepts:
            assert r[c] == pytest.approx(expected[r.key][c], abs=0.01)
    assert spread.model.count() == local.model.count()


@pytest.mark.parametrize("sent", [0, 10**6])
def test_products_by_pass_and_by_joins(spark, monkeypatch, sent):
    """Blocks and chunks of a few rows, a key that comes twice, against the matrix in memory."""
    monkeypatch.setattr(router_training, "CHUNK", 3)
    monkeypatch.setattr(router_training, "BLOCK_ENTRIES", 4)
    rng = np.random.default_rng(1)
    rows = [(k, i, float(rng.random())) for k in range(11) for i in rng.choice(30, 6, replace=False).tolist()]
    of = {i: {k for k, j, _ in rows if j == i} for i in range(30)}
    entries = spark.createDataFrame([(k, i, w, len(of[i]) > 1) for k, i, w in rows], "key int, i long, weight double, shared boolean")
    labelled = [(k, float(k % 3)) for k in range(11)] + [(4, 1.0)]
    labels = spark.createDataFrame(labelled, "key int, label double")
    dual, intercepts = router_training.fit(entries, labels, "key", 3, 0.01, 60, sent_duals=sent)
    x = np.zeros((12, 30))
    for k, i, w in rows:
        for at, (key, _) in enumerate(labelled):
            if key == k:
                x[at, i] = w
    found = {}
    for r in dual.collect():
        found[r.key] = found.get(r.key, 0) + np.array(r.dual)
    weights = sum(np.outer(x[k], found[k]) for k in range(11))
    z = x @ weights + np.array(intercepts)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(12), [int(c) for _, c in labelled]] -= 1
    assert len(dual.collect()) == 12
    assert np.abs(x.T @ p / 12 + 0.01 * weights).max() < 1e-3
    assert np.abs(p.sum(axis=0) / 12).max() < 1e-3
