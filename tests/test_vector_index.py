"""Stored clusters against a search that scores every pair."""

import numpy as np

from parchment.operators import vectors
from parchment.operators.vector_index import VectorIndex, fit_centres


def table(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, vector array<float>")


def rows_of(top):
    return sorted((r.query_id, r.doc_id, round(r.similarity, 6), r.semantic_rank) for r in top.collect())


def stats_of(stats):
    return sorted((r.query_id, r.n, *[round(r[c], 5) for c in ("best", "mean", "std", "z")]) for r in stats.collect())


def test_same_rows_and_closed_clusters(spark, tmp_path):
    rng = np.random.default_rng(3)
    topics = rng.normal(size=(40, 16))
    docs = [(i, topics[i % 40] + 0.1 * rng.normal(size=16)) for i in range(1_500)]
    docs += [(5_000 + i, topics[0]) for i in range(700)] + [(9_000, None), (9_001, np.zeros(16))]
    asked = [(q, topics[q] + 0.1 * rng.normal(size=16)) for q in range(30)] + [(90, None), (91, np.zeros(16)), (92, rng.normal(size=16))]
    passages, queries = table(spark, docs, "doc_id").repartition(6), table(spark, asked, "query_id")
    index = VectorIndex(spark, str(tmp_path / "index"), ["doc_id"])
    index.build(passages, clusters=60, sample=800)
    top, stats, opened = index.find(queries, limit=10)
    want_top, want_stats = vectors.vector_search(passages, queries, ["doc_id"], limit=10)
    assert rows_of(top) == rows_of(want_top) and stats_of(stats) == stats_of(want_stats)
    assert all(few < 0.35 * pairs for few, pairs in opened)
    blocks = index.find(queries, limit=10, block=7)
    assert rows_of(blocks[0]) == rows_of(want_top) and len(blocks[2]) == 5


def test_empty_tables(spark, tmp_path):
    docs, queries = table(spark, [(1, [1, 0]), (2, [0, 1])], "doc_id"), table(spark, [(1, [1, 1])], "query_id")
    index = VectorIndex(spark, str(tmp_path / "a"), ["doc_id"])
    index.build(docs)
    assert rows_of(index.find(queries)[0]) == [(1, 1, 0.707107, 1), (1, 2, 0.707107, 2)]
    assert index.find(queries.limit(0))[0].collect() == []
    none = VectorIndex(spark, str(tmp_path / "b"), ["doc_id"])
    none.build(docs.limit(0))
    assert none.find(queries)[0].collect() == [] and none.find(queries)[1].collect() == []


def test_centres_are_units():
    centres = fit_centres(np.random.default_rng(1).normal(size=(50, 5)), 8)
    assert centres.shape == (8, 5) and np.allclose((centres**2).sum(axis=1), 1)
