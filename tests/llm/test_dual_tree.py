"""Dual-tree search against scoring every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import dual_tree as D

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(AZ) for w in TERM.findall(text or "")]


def brute(docs, items, top=50):
    counts = [Counter(words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, n in zip(docs, counts, sizes):
            score = 0
            for t in set(words(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + (50 * n * n_docs) // n_terms
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda r: r[:3])
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(scored[:top])]
    return sorted(out, key=repr)


def corpus(n, seed=2):
    rng = random.Random(seed)
    common, rare = ["the", "Of", "und", "ÄÖ", "7"], [f"r{i}" for i in range(400)]
    docs = []
    for i in range(n):
        text = rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 6))
        rng.shuffle(text)
        docs.append((i * 3, rng.choice([" ", "-", "\n", "_"]).join(text)))
    hot = "the r1 R2 r3 of " * 3
    docs += [(10_000 + i, hot) for i in range(n // 2)]
    docs += [(None, hot), (None, "r9 the"), (5, None), (6, ""), (7, "!?"), (9, "r5 " * 20_000), (0, "r5"), (0, "r5")]
    items = [(f"i{k}", " ".join(rng.choices(rare + common, k=rng.randint(1, 8)))) for k in range(40)]
    items += [("hot", "r1 r2 THE r3"), ("none", "zzz"), ("empty", ""), ("null", None), (None, "r5 r9"), ("i1", "r5"), ("tie", "r5 r5")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("round", F.lit("y"))
    i = spark.createDataFrame(items, "item_id string, text string").withColumn("score", F.lit(0))
    return d.repartition(5), i.repartition(2)


@pytest.mark.parametrize("more", [{}, {"block_terms": 60, "tree_postings": 500}])
def test_same_as_scoring_every_pair(spark, more):
    docs, items = corpus(500)
    got = D.rank(*frames(spark, docs, items), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_vocabulary_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(D, "fits_broadcast", lambda df: False)
    docs, items = corpus(60)
    got = D.rank(*frames(spark, docs, items), top=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(5))
    assert D.rank(docs.limit(0), items).collect() == []
    empty = D.rank(docs, items.limit(0))
    assert empty.collect() == [] and dict(empty.dtypes)["doc_id"] == "bigint"


def test_batches_are_pruned_above_the_leaves():
    rng = random.Random(4)
    topics = [[f"t{a}w{b}" for b in range(30)] for a in range(60)]
    held = [(k, sorted(set(rng.choices(topics[k % 60], k=8)))) for k in range(120)]
    block = D.Block(held)
    texts = [Counter(w.encode() for w in rng.choices(topics[rng.randrange(60)], k=40)) for _ in range(6_000)]
    df = Counter(t for c in texts for t in c)
    block.weigh(df, len(texts))
    postings = [sorted((block.vocabulary[t], c) for t, c in text.items() if t in block.vocabulary) for text in texts]
    sizes = np.array([len(p) for p in postings])
    term = np.array([t for p in postings for t, _ in p], np.int64)
    tf = np.array([c for p in postings for _, c in p], np.int64)
    n = np.full(len(texts), 40)
    tree, order = D.doc_tree(block, sizes, term, tf, n, len(texts), 40 * len(texts))
    seen, best = Counter(), D.Best(np.zeros(len(held), np.int64), 10)
    D.search(block.tree, tree, order, np.zeros(len(order), bool), best, seen)
    assert len(best.item) == 1_200
    assert seen[0, 0] < 0.2 * len(held) * len(texts)
    # What is left out is below the weakest kept score of its item.
    i, d = np.divmod(np.arange(len(held) * len(texts)), len(texts))
    score = D.bounds(block.tree, 0, tree, 0, i, d).reshape(len(held), -1)
    for k in range(len(held)):
        assert sorted(best.score[best.item == k]) == sorted(score[k])[-10:]
