"""Nearest-centroid language identification."""

import random

import numpy as np
from pyspark.sql import functions as F

from parchment.llm import langid

SYLLABLES = {"aa": ["ka", "to", "ri", "nu"], "bb": ["sch", "ung", "er", "ein"], "cc": ["ción", "ado", "llo", "ñe"], "dd": ["это", "как", "при", "жи"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((k, speak(rng, lang, rng.choice([3, 20, 200])), lang))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "これは全く別の文字です" * 20, None), (None, speak(rng, "aa", 30), "aa"),
             (1004, "X" + "ka to ri " * 40_000, "aa"), (3, rows[3][1], rows[3][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_accuracy_and_rejection(spark):
    docs, rows = corpus(spark)
    got = langid.identify(docs.withColumn("score", F.lit("x")), sample=60)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    found = got.collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    tested = [(by_id[i].lang_pred, lang) for i, t, lang in rows[:300] if by_id[i].held_out]
    assert len(tested) > 40 and np.mean([a == b for a, b in tested]) > 0.97
    for i in (1000, 1001, 1002):
        assert tuple(by_id[i])[2:] == ("und", 0.0, True)
    assert by_id[1003].rejected and by_id[1003].lang_pred in SYLLABLES
    assert not any(by_id[i].rejected for i, t, _ in rows[:300])
    assert by_id[1004].lang_pred == "aa" and all(0 <= r.score <= 1 for r in found)


def test_rejected_rows_go(spark):
    docs, rows = corpus(spark)
    docs = docs.withColumn("rejected", F.lit(True))
    kept = langid.recognised(docs, sample=60)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([r[0] for r in rows if r[0] not in (1000, 1001, 1002, 1003)], key=repr)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, _ = corpus(spark)
    mark = langid.fold(F.col("doc_id"), 4) == 2
    other = docs.withColumn("lang", F.when(mark, F.lit("aa")).otherwise(F.col("lang")))
    a, b = (sorted([tuple(r) for r in langid.identify(d, sample=60).collect()], key=repr) for d in (docs, other))
    assert a == b


def test_a_dirty_label_column_is_learned_by_its_frequent_values(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 5)
    docs, _ = corpus(spark)
    dirt = spark.range(40).select((F.col("id") + 50_000).alias("doc_id"), F.lit("zz yy xx").alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    both = docs.select("doc_id", "text", "lang").unionByName(dirt)
    known = {r.lang for r in docs.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count")).limit(5).collect()}
    assert {lang for lang in langid.fit(both, 60).langs} >= {lang for lang in known if not lang.startswith("x")}


def test_nothing_to_learn_or_read(spark):
    docs, rows = corpus(spark, 20)
    blind = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in blind} == {("und", 0.0, True)}
    assert langid.identify(docs.limit(0)).collect() == []
    assert langid.recognised(docs.limit(0)).collect() == []


def test_counts_against_a_plain_count():
    texts = ["Ab b", "", "--", "éé"]
    n, letters = langid.counts(texts)
    # " ab b ": a b b / " a" "ab" "b " " b" "b " / " ab" "ab " "b b" " b "
    assert n.sum(axis=1).tolist() == [3 + 5 + 4, 0, 0, 2 + 3 + 2] and letters.tolist() == [3, 0, 0, 2]
