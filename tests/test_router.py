import pytest
from pyspark.sql import functions as F

from parchment.operators import router

TEXTS = {
    "qa": ["What is the cap?", "When does the term end?", "Who pays the fee?", "Which law applies?"],
    "summary": ["Summarise the deal.", "Give an overview please.", "Short recap of everything.", "Main points please."],
    "extract": ["Extract all dates.", "List every amount.", "Pull out all fees.", "Table of deadlines."],
}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, label, t) for i, (label, t) in enumerate((k, t) for k, v in TEXTS.items() for t in v)]
    df = spark.createDataFrame(rows, "key int, label string, text string")
    return df, router.train(df, "key", "label")


def test_training_texts_come_back_right(fitted):
    df, model = fitted
    scored = router.predicted(model.predict(df, "key"), list(model.intercepts)).join(df.select("key", "label"), "key")
    assert router.require_accuracy(scored) == 1.0
    assert router.confusion(scored).count() == 3


def test_probabilities_sum_to_one_and_unknown_words_get_base_rates(spark, fitted):
    _, model = fitted
    new = spark.createDataFrame([(1, "extract the dates"), (2, "zzz qqq")], "key int, text string")
    rows = {r.key: r for r in model.predict(new, "key").collect()}
    for r in rows.values():
        assert sum(r[c] for c in model.intercepts) == pytest.approx(1)
    assert rows[1].extract > 0.5
    assert rows[2].qa == pytest.approx(1 / 3, abs=0.05)


def test_published_model_scores_the_same(fitted):
    df, model = fitted
    full = {r.key: r for r in model.parity(df, "key", 3).collect()}
    for r in model.rounded().parity(df, "key", 3).collect():
        for c in model.intercepts:
            assert r[c] == pytest.approx(full[r.key][c], abs=0.0011)


def test_gate(spark):
    with pytest.raises(ValueError):
        router.require_accuracy(spark.createDataFrame([("a", "b")], ["label", "predicted"]))


def test_grams(one):
    assert one(router.grams, "A Big-Red 7x dog") == ["big", "red", "7x", "dog", "big red", "red 7x", "7x dog"]
    assert one(router.grams, "x") == []


def test_training_checks(spark):
    a = spark.createDataFrame([("qa", "Same text"), ("qa", "other")], ["label", "text"])
    b = spark.createDataFrame([("qa", "same TEXT")], ["label", "text"])
    got = {tuple(r) for r in router.training_problems(a, b, "label", ["qa", "summary"]).collect()}
    assert got == {("in both sets", "same text"), ("no examples", "summary")}


@pytest.mark.parametrize(
    "text, probs, has_document, overlap, intent, reason",
    [
        ("hello", (0.9, 0.05, 0.05), False, 0.0, "chat", "no document loaded"),
        ("recap this", (0.6, 0.1, 0.3), True, 0.0, "summary", "summary phrasing"),
        ("tell a joke", (0.2, 0.6, 0.2), True, 0.1, "general", "unrelated to the document"),
        ("tell a joke", (0.2, 0.6, 0.2), True, 0.5, "qa", "possibly general, but shares vocabulary with the document"),
        ("hmm", (0.2, 0.4, 0.4), True, 0.0, "qa", "possibly general, but shares vocabulary with the document"),
        ("hmm", (0.3, 0.3, 0.4), True, 0.0, "qa", "low confidence for summary"),
        ("what", (0.8, 0.1, 0.1), True, 0.0, "qa", "router"),
    ],
)
def test_rules(spark, text, probs, has_document, overlap, intent, reason):
    df = spark.createDataFrame([(text, has_document, overlap)], ["text", "has_document", "overlap"])
    for c, p in zip(("qa", "general", "summary"), probs, strict=True):
        df = df.withColumn(c, F.lit(p))
    r = router.route(df, ["general", "qa", "summary"]).first()
    assert (r.intent, r.reason) == (intent, reason)
