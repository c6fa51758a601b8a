"""Examples found in slices of questions and blocks of records, against brute force."""

import random

import numpy as np
import pyarrow as pa

from parchment.operators import feedback
from tests.test_search import RECORD_SCHEMA


def _wanted(questions, records):
    out = {}
    for qid, q in questions:
        a, scored = set(q.split()), []
        for r in records:
            b = set(r[3].split())
            if (s := len(a & b) / len(a | b)) >= 0.2:
                scored.append((-s, r[0], -(-len(r[3]) // 3) + -(-len(r[4]) // 3) + 8))
        used = place = 0
        for _, i, cost in sorted(scored):
            if place < 2 and used + cost <= 220:
                place, used = place + 1, used + cost
                out[(qid, place)] = i
    return out


def test_best_and_next_that_fits_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(feedback, "SLICE", 40)
    monkeypatch.setattr(feedback, "BLOCK", 30)
    rng = random.Random(8)
    words = [f"term{i}q" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, weights=range(1, 31), k=rng.randint(1, 15)))
    records = [(i, "qa", "up", text(), "a" * rng.randint(1, 600), None) for i in range(200)]
    questions = [(i, text()) for i in range(120)]
    asked = spark.createDataFrame(questions, "question_id int, text string")
    found = feedback.select_examples(asked, spark.createDataFrame(records, RECORD_SCHEMA))
    assert {(r.question_id, r.place): r.id for r in found.collect()} == _wanted(questions, records)


def test_pairs_of_similar_texts_do_not_leave_their_task(spark):
    """200 term sets and 300 records that are all similar: two rows each where all cost the same, not 300."""
    asked = spark.createDataFrame([(f"alike common q{i}",) for i in range(200)], "left_key string")
    front = spark.createDataFrame([(f"alike common r{i}", i, 50) for i in range(300)], "right_key string, id int, cost int")
    rows = feedback.similar_records(asked, front, "id", 0.2).collect()
    assert len(rows) == 400
    assert {r.id for r in rows} == {0, 1} and {r.similarity for r in rows} == {0.5}


SCHEMA = pa.schema([("left_key", pa.string()), ("id", pa.int64()), ("cost", pa.int64()), ("similarity", pa.float64())])


def _compared(asked, records):
    left = pa.table({"left_key": asked})
    right = pa.table({"right_key": [r[0] for r in records], "id": [r[1] for r in records], "cost": [r[2] for r in records]})
    rows = feedback._front_rows(0.2, SCHEMA)(right, left).to_pylist()
    return sorted((r["left_key"], r["id"], r["cost"], r["similarity"]) for r in rows)


def _by_hand(asked, records):
    out = []
    for q in asked:
        a, least = set(q.split()), None
        scored = [(len(a & (b := set(k.split()))) / len(a | b), i, cost) for k, i, cost in records]
        for place, (s, i, cost) in enumerate(sorted((x for x in scored if x[0] >= 0.2), key=lambda x: (-x[0], x[1]))):
            if place == 0 or least is None or cost < least:
                out.append((q, i, cost, s))
            if place:
                least = cost if least is None else min(cost, least)
    return sorted(out)


def test_term_sets_of_all_sizes_are_compared_as_by_hand():
    rng = random.Random(3)
    words = [f"t{i}" for i in range(400)]
    text = lambda most: " ".join(sorted({rng.choice(words[: rng.choice((3, 30, 400))]) for _ in range(rng.randint(1, most))}))
    for most in (2, 9, 40, 150):
        asked = sorted({text(most) for _ in range(120)} | {"unheard of", "t1"})
        records = [(text(rng.choice((3, most))), i, rng.randint(10, 60)) for i in range(300)]
        records += [(k, 1000 + i, rng.randint(10, 60)) for i, k in enumerate(asked[:20])]
        assert _compared(asked, records) == _by_hand(asked, records)
    assert _compared(["none such"], [("t1 t2", 1, 5)]) == []
    assert _compared([" ".join(words)], [(" ".join(words[:300]), 1, 5), ("t1", 2, 5)]) == [(" ".join(words), 1, 5, 0.75)]


def test_common_terms_do_not_make_the_work_grow_with_the_square(monkeypatch):
    """Four terms that every text has and 16 of its own: twice the questions and records are about twice the work."""

    class Counted:
        def __init__(self):
            self.cells = 0

        def __getattr__(self, name):
            what = getattr(np, name)
            if name not in ("concatenate", "bincount", "flatnonzero"):
                return what

            def run(*args, **more):
                out = what(*args, **more)
                self.cells += out.size
                return out

            return run

    def work(n):
        rng = random.Random(n)
        text = lambda: " ".join(["all", "have", "these", "words", *(f"w{x}" for x in rng.sample(range(20 * n), 16))])
        monkeypatch.setattr(feedback, "np", counted := Counted())
        _compared([text() for _ in range(n)], [(text(), i, 50) for i in range(n)])
        return counted.cells

    assert work(1000) < 2.6 * work(500)
