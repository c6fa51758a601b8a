"""Subword toxicity scores: held-out accuracy, misspellings, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import toxicity

PLAIN = ["".join(c) for c in zip("bcdfgklmnp" * 12, "aeiou" * 24, "lrstn" * 24, "aoeiu" * 24, "ktmdv" * 24)]
RUDE = ["grumblesnort", "wretchling", "foulbeard"]
ODD = ["grumblesn0rt", "wretchlingz", "xfoulbeard", "grumblesnortt"]


def text_of(rng, toxic, words=RUDE):
    body = [rng.choice(PLAIN) + rng.choice(PLAIN) for _ in range(rng.choice([5, 40, 400]))]
    if toxic:
        for _ in range(1 + len(body) // 60):
            body[rng.randrange(len(body))] = rng.choice(words)
    return " ".join(body)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(k, text_of(rng, k % 4 == 0), int(k % 4 == 0)) for k in range(500)]


def tables(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + list(extra), "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    return docs, labels


def test_held_out_accuracy_and_unseen_spellings(spark, rows):
    rng = random.Random(8)
    odd = [(9000 + k, text_of(rng, True, ODD)) for k in range(40)]
    extra = odd + [(9100, None), (9101, ""), (9102, "?! \n"), (None, "grumblesnort"), (9103, rows[1][1] * 300), (5, rows[5][1])]
    docs, labels = tables(spark, rows, extra)
    labels = labels.unionByName(spark.createDataFrame([(3, None), (4, 0), (777777, 1), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.assess(docs.withColumn("toxic", F.lit("clash")), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in found}
    tested = [(by_id[i].predicted, x) for i, _, x in rows if by_id[i].held_out]
    assert len(tested) > 60 and np.mean([a == b for a, b in tested]) > 0.95
    assert np.mean([by_id[i].predicted for i, _ in odd]) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert not any(by_id[i].predicted for i in (9100, 9101, 9102, 9103))


def test_labels_of_the_held_out_fold_are_not_learned(spark, rows):
    docs, labels = tables(spark, rows[:120])
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.assess(docs, x).collect()) for x in (labels, other))
    assert a == b


def test_the_sample_is_bounded(spark, rows):
    docs, labels = tables(spark, rows[:60])
    assert toxicity.fit(docs, labels, sample=5, sample_chars=1).scale > 0


def test_a_very_long_text_leaves_room_for_the_others(spark, rows):
    docs, labels = tables(spark, rows[:60])
    long = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("long text "), 900)).otherwise(F.left("text", F.lit(90))))
    drawn = {r.doc_id for r in toxicity.training_texts(long, labels, 60, 10_000).collect()}
    assert {i for i, _, _ in rows[:60] if i % 5} <= drawn and len(drawn) < 60


def test_labels_above_one_are_toxic(spark, rows):
    docs, labels = tables(spark, rows[:150])
    more = labels.withColumn("toxic", F.col("toxic") * 7 - (F.col("toxic") == 0).cast("int"))
    a, b = (sorted(tuple(r) for r in toxicity.assess(docs, x).collect()) for x in (labels, more))
    assert a == b


def test_one_class_no_labels_no_rows(spark, rows):
    docs, labels = tables(spark, rows[:20])
    none = toxicity.assess(docs, labels.limit(0)).collect()
    only = toxicity.assess(docs, labels.withColumn("toxic", F.lit(1))).collect()
    assert {r.predicted for r in none} == {0} and {r.predicted for r in only} == {1}
    assert toxicity.assess(docs.limit(0), labels).collect() == []


def test_subwords_of_a_word():
    slot, passage, owner = toxicity.subwords(["ab cde", "", "f"])
    # " ab ": itself, 2 of three letters, 1 of four; " cde ": itself, 3, 2, 1; " f ": itself, 1
    assert np.bincount(passage).tolist() == [4 + 7, 2] and owner.tolist() == [0, 2]
    assert len(slot) == 13
