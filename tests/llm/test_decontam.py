"""Positional index and decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parchment.llm import decontam

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b


def sample(seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünit", "straße", "A1", "x"] + [f"w{k}" for k in range(30)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([1, 3, 9, 10, 14, 30])))) for k in range(2, 14)]
    items = [(k, t) for k, t in items if len(t.split()) > 2] + [(50, None), (51, ""), (52, "--"), (53, items[-1][1].upper()), (54, "rare unseen words")]
    docs = []
    for k in range(60):
        body = say(rng.choice([0, 1, 8, 40, 200]))
        for _ in range(rng.choice([0, 1, 2])):
            piece = rng.choice([t for _, t in items if t]).split()
            lo = rng.randrange(len(piece))
            piece = piece[lo : lo + rng.choice([5, 10, 12, 40])]
            at = rng.randrange(len(body) + 1)
            body[at:at] = piece
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(100, None), (101, ""), (None, docs[3][1]), (7, docs[7][1]), (102, " ".join(say(30_000)))]
    return docs, items


def brute(docs, items, size=10):
    cut = []
    for i, t in items:
        w = words(t)
        if w:
            cut += [(i, tuple(w[k : k + size])) for k in range(max(1, len(w) - size + 1))]
    out = []
    for i, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for item, win in set(cut):
            for p in range(len(w) - len(win) + 1):
                if w[p] == win[0] and tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, segment", [(50_000, 500_000), (7, 300)])
def test_contamination_matches_brute_force(spark, block, segment):
    docs, items = sample()
    d, b = tables(spark, docs, items)
    got = decontam.contamination(d.withColumn("item_id", F.lit(1)).withColumn("terms", F.lit(2)), b, block=block, segment_words=segment)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(docs, items)


def test_clean_documents_stay_as_they_were(spark):
    docs, items = sample(9)
    d, b = tables(spark, docs, items)
    d = d.withColumn("key_text", F.lit("k"))
    kept = decontam.clean(d, b)
    want = [r for r in brute(docs, items)]
    bad = {(r[0], r[1]) for r in want if r[5]}
    assert kept.columns == d.columns
    assert sorted([(r.doc_id, len(words(r.text))) for r in kept.collect()], key=repr) == sorted([(r[0], r[1]) for r in want if (r[0], r[1]) not in bad], key=repr)


@pytest.mark.parametrize("block", [50_000, 1])
def test_items_without_an_id_count_as_one(spark, block):
    docs = [(1, "a b c"), (2, "x, c d e"), (3, "a b c d e"), (4, "nothing"), (None, "c d e")]
    d, b = tables(spark, docs, [(None, "a b"), (None, "d e"), (7, "c d"), (12, "B c"), (None, None)])
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    want = [(1, 3, 3, 2, sha("12"), True), (2, 4, 3, 2, sha("7"), True), (3, 5, 5, 3, sha("12,7"), True), (4, 1, 0, 0, sha(""), False), (None, 3, 3, 2, sha("7"), True)]
    got = decontam.contamination(d, b, block=block, segment_words=4)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert [r.doc_id for r in decontam.clean(d, b).collect()] == [4]


def test_matches_of_a_query_without_an_id(spark):
    d, _ = tables(spark, [(1, "a b a b")], [])
    q = spark.createDataFrame([(None, ["a", "b"]), (1, ["b", "a"])], "query_id long, words array<string>")
    assert sorted([tuple(r) for r in decontam.matches(d, q).collect()], key=repr) == [(1, 1, 1, 3), (1, None, 0, 2), (1, None, 2, 4)]


def test_empty_tables(spark):
    d, b = tables(spark, [], [])
    full, items = tables(spark, *sample())
    assert decontam.contamination(d, items).collect() == []
    assert {(r.n_hit, r.contaminated) for r in decontam.contamination(full, b).collect()} == {(0, False)}
    assert decontam.clean(d, b).collect() == []


def near(docs, queries, slop):
    out = []
    for i, t in docs:
        w = words(t)
        for qi, q in queries:
            for s in range(len(w)):
                if w[s] not in q:
                    continue
                need = {x: q.count(x) for x in q}
                for e in range(s, min(len(w), s + len(q) + slop)):
                    if w[e] in need:
                        need[w[e]] -= 1
                    if all(v <= 0 for v in need.values()):
                        out.append((i, qi, s, e + 1))
                        break
    return sorted(out, key=repr)


@pytest.mark.parametrize("slop", [0, 4])
def test_proximity_matches_brute_force(spark, slop):
    docs, _ = sample(6)
    docs = docs[:-1]
    queries = [(1, ["the", "of"]), (2, ["w1", "w2", "w1"]), (3, ["x"]), (4, ["w5", "ünit", "w9"]), (5, ["absent", "x"])]
    d, _ = tables(spark, docs, [])
    q = spark.createDataFrame(queries, "query_id long, words array<string>")
    got = decontam.matches(d, q, slop=slop, block=2, segment_words=400)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == near(docs, queries, slop)


def test_exact_phrase_places(spark):
    d, _ = tables(spark, [(1, "a b a b a"), (2, "A, b."), (3, None)], [])
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a", "b"])], "query_id long, words array<string>")
    assert sorted(tuple(r) for r in decontam.matches(d, q).collect()) == [(1, 1, 0, 2), (1, 1, 2, 4), (1, 2, 1, 4), (2, 1, 0, 2)]
