import math
import random

import pytest
from pyspark.sql import functions as F

from parchment.functions.text import keyword_text
from parchment.operators import chunking, feedback, search, selection, vectors
from tests.test_chunking import contract


def passages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def ask(spark, texts, question):
    q = spark.createDataFrame([(0, question)], "query_id long, text string")
    m = search.match_queries(passages(spark, texts), q, ["id"])
    return m, q


def test_coverage_weighs_rare_terms(spark):
    texts = ["in good faith", "good industry practice", "good conduct", "liability cap"]
    m, q = ask(spark, texts, "recommend a good pasta recipe")
    assert search.coverage(m, q).first().weighted_coverage < 0.2
    m, q = ask(spark, texts, "liability cap")
    assert search.coverage(m, q).first().weighted_coverage == 1


def test_best_hit_and_counts(spark):
    texts = ["the cat sat on the mat", "liability is capped at two million", "the dog sat on the log"]
    m, q = ask(spark, texts, "what is the liability cap?")
    hits = search.bm25(m).orderBy("lexical_rank").collect()
    assert hits[0].id == 1
    c = search.coverage(m, q).first()
    assert (c.matched_terms, c.query_terms, c.chunk_count) == (2, 2, 3)


def test_question_without_terms(spark):
    m, q = ask(spark, ["a cat", "a dog"], "what does this mean?")
    c = search.coverage(m, q).first()
    assert (c.matched_terms, c.query_terms, c.weighted_coverage) == (0, 0, 0.0)


def test_bm25_against_brute_force_with_a_hot_term_and_copies(spark):
    rng = random.Random(7)
    words = [f"word{i}x" for i in range(30)]
    texts = [" ".join(["common"] * 3 + rng.choices(words, k=rng.randint(3, 12))) for _ in range(120)] + ["common alpha beta"] * 60
    queries = [(i, " ".join(["common", *rng.choices(words, k=3)])) for i in range(6)]
    got = search.bm25(
        search.match_queries(passages(spark, texts), spark.createDataFrame(queries, "query_id long, text string"), ["id"])
    ).collect()
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / len(docs)
    for qid, text in queries:
        scores = []
        for i, d in enumerate(docs):
            s = 0.0
            for t in set(text.split()):
                df = sum(t in x for x in docs)
                f = d.count(t)
                if f:
                    s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / avg))
            if s > 0:
                scores.append((-round(s, 9), i))
        expected = [i for _, i in sorted(scores)[:20]]
        assert [r.id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r.lexical_rank)] == expected


def test_corpus_is_cut_once_per_search(spark, tmp_path):
    """Scores and statistics read the same exchange of passage rows."""
    path = str(tmp_path / "p")
    passages(spark, ["liability cap", "a cat"] * 5).write.parquet(path)
    q = spark.createDataFrame([(0, "liability cap")], "query_id long, text string")
    df = search.bm25(search.match_queries(spark.read.parquet(path), q, ["id"]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_contract_question(spark):
    c = chunking.chunk_pages(contract(spark), ["doc_id"]).withColumn("k", keyword_text(F.col("section"), F.col("text")))
    q = spark.createDataFrame([(0, "What is the total of the repair cover?")], "query_id long, text string")
    m = search.match_queries(c, q, ["doc_id", "chunk_idx"], text="k")
    ranked = search.bm25(m).join(c.select("doc_id", "chunk_idx", "text", "page"), ["doc_id", "chunk_idx"])
    picked = selection.pick(ranked, "lexical_rank", F.lit(1200)).join(c.select("doc_id", "chunk_idx", "text"), ["doc_id", "chunk_idx"])
    assert any("£1,750,000" in r.text and r.page == 4 for r in picked.collect())


@pytest.mark.parametrize("semantic, terms, matched, n, expected", [
    (False, 3, 0, 12, True), (False, 3, 0, 11, False), (True, 3, 0, 20, False), (False, 0, 0, 20, False), (False, 3, 1, 20, False),
])
def test_abstain(spark, semantic, terms, matched, n, expected):
    lit = F.lit
    row = spark.range(1).select(search.should_abstain(lit(semantic), lit(terms), lit(matched), lit(n)).alias("x")).first()
    assert row.x is expected


def test_vectors_against_brute_force_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    docs = rng.normal(size=(90, 8))
    docs[30:60] = docs[5]  # a third of all rows are copies of one vector
    qs = rng.normal(size=(7, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "query_id long, vector array<double>")
    top, stats = vectors.vector_search(d, q, ["id"], block=3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(docs) @ unit(qs).T, 9)
    rows = top.collect()
    for j in range(7):
        expected = sorted(range(90), key=lambda i: (-sims[i, j], i))[:20]
        assert [r.id for r in sorted((r for r in rows if r.query_id == j), key=lambda r: r.semantic_rank)] == expected
    for r in stats.collect():
        assert r.mean == pytest.approx(sims[:, r.query_id].mean(), abs=1e-6)
        assert r.z == pytest.approx((sims[:, r.query_id].max() - sims[:, r.query_id].mean()) / sims[:, r.query_id].std(), abs=1e-4)


def test_fusion_guarantees_each_rankers_best(spark):
    lex = spark.createDataFrame([(0, i, 10.0 - i, i) for i in range(1, 6)], "query_id int, id int, score double, lexical_rank int")
    sem = spark.createDataFrame([(0, 10 + i, 0.9 - i / 100, i) for i in range(1, 6)], "query_id int, id int, similarity double, semantic_rank int")
    got = [r.id for r in search.fuse(lex, sem, ["id"]).orderBy("final_rank").collect()]
    assert got == [1, 11, 2, 12, 3, 13, 4, 14, 5, 15]


def test_pick_skips_what_does_not_fit_and_goes_on(spark):
    rows = [(0, 1, "x" * 300), (0, 2, "y" * 3000), (0, 3, "z" * 30)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, text string").withColumn("id", F.col("rank"))
    got = selection.pick(ranked, "rank", F.lit(200)).orderBy("rank").collect()
    assert [(r.id, r.source_id) for r in got] == [(1, "S1"), (3, "S2")]


def test_spread_takes_both_ends(spark):
    chunks = spark.createDataFrame([(1, i, "t" * 900) for i in range(40)], "doc_id int, chunk_idx int, text string")
    got = sorted(r.chunk_idx for r in selection.select_spread(chunks, ["doc_id"], F.lit(2600)).collect())
    assert got[0] == 0 and got[-1] == 39 and len(got) == 8


@pytest.mark.parametrize("a, b, expected", [(0.78, 0.622, None), (0.487, 0.505, None), (0.568, 0.607, 0.94), (0.5, 0.0, None)])
def test_relevance_issue(spark, a, b, expected):
    assert spark.range(1).select(vectors.relevance_issue(F.lit(a), F.lit(b)).alias("x")).first().x == expected


RECORDS = [
    (1, "qa", "up", "What is the liability cap?", "The cap is £2,500,000 [S1].", None),
    (2, "qa", "down", "How much notice is needed to terminate?", "30 days", "Notice is ninety (90) days."),
    (3, "qa", "down", "What is the liability limit?", "bad", ""),
    (4, "extract", "up", "What is the liability cap amount?", "table", None),
    (5, "qa", "up", "Recommend a pasta recipe", "...", None),
]
RECORD_SCHEMA = "id int, intent string, rating string, question string, answer string, correction string"


def test_examples(spark):
    rated = spark.createDataFrame(RECORDS, RECORD_SCHEMA)
    questions = spark.createDataFrame(
        [(1, "What's the cap on liability?"), (2, "How much notice to terminate the agreement?"), (3, "Who owns the IP?")],
        "question_id int, text string",
    )
    got = {(r.question_id, r.place): r.approved for r in feedback.select_examples(questions, rated).collect()}
    assert got == {(1, 1): "The cap is £2,500,000.", (2, 1): "Notice is ninety (90) days."}
    long = spark.createDataFrame([(1, "qa", "up", "What is the liability cap?", "x" * 2000, None)], RECORD_SCHEMA)
    assert feedback.select_examples(questions, long).count() == 0


def test_examples_against_brute_force_with_copies(spark):
    rng = random.Random(5)
    words = [f"term{i}q" for i in range(12)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(1, 6)))
    records = [(i, "qa", "up", text(), "a" * rng.randint(1, 500), None) for i in range(80)]
    records += [(80 + i, "qa", "up", "term1q term2q", "b" * (30 * (i % 4)), None) for i in range(40)]
    questions = [(i, text()) for i in range(30)] + [(30 + i, "term1q term2q") for i in range(15)]
    got = {
        (r.question_id, r.place): r.id
        for r in feedback.select_examples(
            spark.createDataFrame(questions, "question_id int, text string"), spark.createDataFrame(records, RECORD_SCHEMA)
        ).collect()
    }
    expected = {}
    for qid, q in questions:
        a, scored = set(q.split()), []
        for r in records:
            b = set(r[3].split())
            s = len(a & b) / len(a | b)
            if s >= 0.2:
                scored.append((-s, r[0], -(-len(r[3]) // 3) + -(-len(r[4]) // 3) + 8))
        used, place = 0, 0
        for _, i, cost in sorted(scored):
            if place < 2 and used + cost <= 220:
                place, used = place + 1, used + cost
                expected[(qid, place)] = i
    assert got == expected


def test_many_queries_in_small_blocks(spark):
    """5,000 query vectors in one pass of several blocks equal a plain matrix product."""
    import numpy as np

    from parchment.operators import vectors

    rng = np.random.default_rng(3)
    passages, queries = rng.integers(-2, 3, (60, 4)).astype(float), rng.normal(size=(5000, 4))
    p = spark.createDataFrame([(k % 7, k, v.tolist()) for k, v in enumerate(passages)], "a long, b long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(queries)], "query_id long, vector array<double>")
    top, stats = vectors.vector_search(p, q, ["a", "b"], limit=3, block=700, blocks=3)
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    scores = np.round(unit(passages) @ unit(queries).T, 9)
    got = {}
    for r in top.collect():
        got.setdefault(r.query_id, {})[r.semantic_rank] = (r.a, r.b)
    for k in range(0, 5000, 97):
        want = sorted(range(60), key=lambda i: (-scores[i, k], i % 7, i))[:3]
        assert [got[k][n] for n in (1, 2, 3)] == [(i % 7, i) for i in want]
    assert len(got) == 5000 and stats.count() == 5000
    assert {r.n for r in stats.collect()} == {60}


def test_few_queries_keep_one_block_of_scores_per_task(spark, monkeypatch):
    """Equal scores by passage order over blocks and tasks, queries with equal terms as one class."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = [(n // 3, n % 3, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id int, chunk_idx int, text string").repartition(5)
    asked = [(q, " ".join(rng.choices([*words, "absent"], k=2))) for q in range(60)]
    queries = spark.createDataFrame([*asked, (60, "absent"), (61, "")], "query_id int, text string")
    m = search.match_queries(docs, queries, ["doc_id", "chunk_idx"])
    monkeypatch.setattr(search, "_CELLS", 500)
    few = search.bm25(m, 7)
    assert "MapInArrow" in few._jdf.queryExecution().optimizedPlan().toString()
    m.few = False
    want = {(r.query_id, r.lexical_rank): (r.doc_id, r.chunk_idx, round(r.score, 8)) for r in search.bm25(m, 7).collect()}
    got = {(r.query_id, r.lexical_rank): (r.doc_id, r.chunk_idx, round(r.score, 8)) for r in few.collect()}
    assert got == want and len(got) == 7 * sum(set(t.split()) != {"absent"} for _, t in asked)
