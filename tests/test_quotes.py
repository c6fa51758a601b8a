"""Quotes in a corpus against a plain walk over all pairs."""

import random

from pyspark.sql import functions as F

from parchment.operators import quotes


def supported(q, h):
    q, h = q.replace('"', "").replace("'", ""), h.replace('"', "").replace("'", "")
    if not q.strip():
        return False
    if q in h:
        return True
    words = q.split(" ")
    if len(words) < 4:
        return False
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    return sum(p in h for p in parts) / len(parts) >= 0.9


def test_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "ab", "cab", "abc"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30, 200])))) for i in range(150)]
    docs += [(1000 + i, "the of the of " * 20 + "tail") for i in range(100)]
    docs += [(2000, ""), (2001, "x 'y' z"), (2002, "x ' z end")]
    asked = []
    for n in range(120):
        words = rng.choice(docs[:150])[1].split(" ")
        at = rng.randrange(len(words))
        cut = words[at : at + rng.choice([1, 2, 3, 4, 15, 60])]
        if len(cut) > 3 and n % 3 == 0:
            cut[rng.randrange(len(cut))] = "changed"
        if n % 4 == 0:
            cut[0], cut[-1] = cut[0][1:] or "q", cut[-1][:-1] or "q"
        asked.append((n, " ".join(cut).strip()))
    asked += [(500, "the of the of the of the of"), (501, "of the"), (502, "'"), (503, ""), (504, "ab"), (505, "b w1"), (506, "the the the the the"), (507, "' z"), (507, "y z")]
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(4)
    q = spark.createDataFrame(asked, "item int, text string")
    got = {(r.item, r.doc_id) for r in quotes.quoted_in(d, q, ["doc_id"], ["item"]).collect()}
    assert got == {(i, k) for i, text in asked for k, h in docs if supported(text, h)}


def test_a_changed_word_and_long_quotes_only(spark):
    words = [f"v{i}" for i in range(50)]
    altered = words[:20] + ["other"] + words[21:]
    d = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, " ".join(words[:30]))], "doc_id int, text string")
    q = spark.createDataFrame([("a", " ".join(altered)), ("b", " ".join(altered[:30])), ("c", " ".join(words[5:45]))], "item string, text string")
    found = quotes.quoted_in(d, q, ["doc_id"], ["item"])
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("c", 1)]
    assert quotes.quoted_in(d, q.limit(0), ["doc_id"], ["item"]).collect() == []
    assert quotes.quoted_in(d.limit(0), q, ["doc_id"], ["item"]).collect() == []


def test_only_the_rarest_keys_meet(spark):
    """A quote of common pairs and a few rare ones is looked up by the rare ones alone."""
    keys = spark.createDataFrame([(1, 1, f"k{i}", 1) for i in range(20)], "quote_no long, may_miss int, key string, n long")
    df = spark.createDataFrame([(f"k{i}", 1000 if i < 17 else i - 15) for i in range(20)], "key string, df long")
    assert {r.key for r in quotes._rarest(keys, df).collect()} == {"k17", "k18"}
    assert quotes._rarest(keys, df.where(F.lit(False))).collect() == []
