"""Keyword and vector search, rank fusion.

Passages are rows keyed by ``keys`` (document and chunk number). Statistics belong to a ``scope``:
none for the whole corpus, or columns such as the document for one index per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.session import fits_broadcast

K1 = 1.2
B = 0.75
CANDIDATES = 20
RRF_K = 60
GUARANTEED = 3
MIN_CHUNKS_TO_GATE = 12

# Every passage carries one row of this term, so one table holds both the postings and the number
# and lengths of all passages. No text yields an empty term.
EVERY = ""


def postings(chunks: DataFrame, keys: list[str], text: str = "text", scope: tuple[str, ...] = ()) -> DataFrame:
    """All postings: (scope, keys, len, term, tf), one ``term = ''`` row per passage.

    The exchange is on the passage key, not the term: each passage's rows arrive together, later
    per-passage sums need no further shuffle, and a term that half of all passages hold is spread.
    """
    return _counted(occurrences(chunks, keys, text, scope), keys, scope)


def occurrences(chunks: DataFrame, keys: list[str], text: str, scope: tuple[str, ...]) -> DataFrame:
    own = [c for c in scope if c not in keys]
    words = chunks.select(*own, *keys, T.term_words(F.col(text)).alias("words"))
    exploded = words.select(
        *own,
        *keys,
        F.size("words").alias("len"),
        F.explode(F.array_append("words", F.lit(EVERY))).alias("word"),
    )
    # Never null, so that joins on the term need no null test, which would stem every word twice.
    return exploded.select(*own, *keys, "len", F.coalesce(T.stem(F.col("word")), F.lit(EVERY)).alias("term"))


def _counted(occurrences: DataFrame, keys: list[str], scope: tuple[str, ...]) -> DataFrame:
    own = [c for c in scope if c not in keys]
    # A stated number is not coalesced: words are narrow in the exchange, but not where they are counted.
    parts = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return occurrences.repartition(parts, *keys).groupBy(*own, *keys, "len", "term").agg(F.count("*").cast("int").alias("tf"))


def _by_term(posted: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    return posted.groupBy(*scope, "term").agg(
        F.count("*").alias("df"), F.sum("len").alias("total_len"), F.max(F.col("term") == EVERY).alias("every")
    )


def _totals(by_term: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """(scope, chunks, avg_len) out of the rows that stand for all passages.

    No filter on the term anywhere: it would be pushed below the exchange of passage rows, and each
    user of that exchange would then read and cut the corpus anew instead of reusing it.
    """
    return by_term.groupBy(*scope).agg(
        F.max(F.when(F.col("every"), F.col("df"))).alias("chunks"),
        F.max(F.when(F.col("every"), F.col("total_len") / F.col("df"))).alias("avg_len"),
    )


def term_stats(posted: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, term, df, chunks, avg_len, idf) from a postings table."""
    by_term = _by_term(posted, scope)
    totals = _totals(by_term, scope)
    # One row per scope: a single row for the corpus.
    joined = by_term.join(totals, list(scope)) if scope else by_term.join(F.broadcast(totals))
    return (
        joined.where(~F.col("every"))
        .drop("total_len", "every")
        .withColumn("idf", idf(F.col("chunks"), F.col("df")))
    )


def idf(chunks, df):
    return F.log(1 + (chunks - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, query_id: str, text: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Distinct terms per query."""
    words = queries.select(*scope, query_id, F.array_distinct(T.tokens(F.col(text))).alias("terms"))
    return words.select(*scope, query_id, F.explode("terms").alias("term"))


@dataclass
class KeywordMatches:
    """Postings of the queries' terms, with the per-term statistics of the scope."""

    matched: DataFrame  # scope, keys, len, term, tf
    stats: DataFrame  # scope, term, df, chunks, avg_len
    terms: DataFrame  # scope, query, term
    keys: list[str]
    scope: tuple[str, ...]
    query_id: str
    shared: bool  # the same queries are put to every scope
    few: bool  # the queries' terms are few enough to be broadcast


def match_queries(
    chunks: DataFrame,
    queries: DataFrame,
    keys: list[str],
    query_id: str = "query_id",
    query_text: str = "text",
    text: str = "text",
    scope: tuple[str, ...] = (),
    shared: bool = False,
) -> KeywordMatches:
    """One pass over the passages: words outside the queries' vocabulary are dropped in the map
    stage, before the only shuffle of passage rows.

    With a ``scope``, queries name theirs in the scope's columns, or are ``shared`` by all scopes.
    """
    asked = () if shared else scope
    terms = query_terms(queries, query_id, query_text, asked)
    vocabulary = terms.select(*asked, "term").distinct()
    if asked:
        # A scope without query is not searched, and needs no statistics.
        marks = terms.select(*scope, F.lit(EVERY).alias("term")).distinct()
    else:
        marks = queries.sparkSession.createDataFrame([(EVERY,)], "term string")
    few = fits_broadcast(terms)
    vocabulary = vocabulary.unionByName(marks)
    vocabulary = F.broadcast(vocabulary) if few else vocabulary
    wanted = occurrences(chunks, keys, text, scope).join(vocabulary, [*asked, "term"])
    matched = _counted(wanted, keys, scope)
    return KeywordMatches(matched, _by_term(matched, scope), terms, keys, scope, query_id, shared, few)


def _weights(m: KeywordMatches) -> DataFrame:
    """Per query term: idf and the scope's totals; df 0 for terms no passage holds."""
    totals = _totals(m.stats, m.scope)
    dfs = m.stats.select(*m.scope, "term", "df")
    if m.shared and m.scope:
        known = dfs.join(F.broadcast(m.terms) if m.few else m.terms, "term")
    else:
        known = m.terms.join(dfs, [*m.scope, "term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    with_totals = known.join(totals, list(m.scope)) if m.scope else known.join(F.broadcast(totals))
    return with_totals.withColumn("idf", idf(F.col("chunks"), F.col("df")))


def bm25(m: KeywordMatches, limit: int = CANDIDATES) -> DataFrame:
    """Top passages per query: (query, keys, score, lexical_rank).

    Scores are added up where the passage's postings already are. Few queries to the whole corpus are
    scored a block of passages at a time; else each task keeps at most ``limit`` rows per query before the
    ranks are settled. Equal scores rank by passage order. Scores are
    compared at nine decimals, so the order in which terms were added cannot change a rank.
    """
    if m.few and not m.scope:
        return _bm25_of_few(m, limit)
    weights = _weights(m).where("df > 0")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9)))
    scored = (
        m.matched.join(weights, [*m.scope, "term"])
        .groupBy(*m.keys, m.query_id, *[c for c in m.scope if c not in m.keys])
        .agg(F.round(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm), 9).alias("score"))
        .where("score > 0")
    )
    best = Window.partitionBy(*m.scope, m.query_id).orderBy(F.desc("score"), *m.keys)
    return scored.withColumn("lexical_rank", F.row_number().over(best)).where(F.col("lexical_rank") <= limit)


def _bm25_of_few(m: KeywordMatches, limit: int) -> DataFrame:
    """``bm25`` for queries of checked number, put to the whole corpus.

    Where its postings are, a passage becomes one row, and blocks of passages are scored at a time. Queries
    with the same terms have the same scores and are one class. A task holds one block's scores and the best
    ``limit`` passages of each class, whatever it reads.
    """
    spark = m.matched.sparkSession
    of_query: dict = {}
    for query, term in m.terms.toLocalIterator():  # they passed the check in front of every broadcast
        of_query.setdefault(query, []).append(term)
    at = {t: i for i, t in enumerate(sorted({t for ts in of_query.values() for t in ts}))}
    classes: dict = {}
    members = [(q, classes.setdefault(tuple(sorted(ts)), len(classes))) for q, ts in of_query.items()]
    kind = m.terms.schema[m.query_id].dataType.simpleString()
    named = spark.createDataFrame(members, f"`{m.query_id}` {kind}, class_of_query int")
    numbered = spark.createDataFrame(list(at.items()), "term string, term_number int")
    pairs = sorted((at[t], c) for ts, c in classes.items() for t in ts)
    first = np.searchsorted([t for t, _ in pairs], np.arange(len(at) + 1))
    held = spark.sparkContext.broadcast((first, np.array([c for _, c in pairs], np.int64)))
    known = m.stats.join(F.broadcast(numbered), "term").join(F.broadcast(_totals(m.stats, ())))
    weights = known.select("term", "term_number", "avg_len", idf(F.col("chunks"), m.stats["df"]).alias("idf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9)))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / norm
    passages = (
        m.matched.join(F.broadcast(weights), "term")
        .groupBy(*m.keys)
        .agg(F.collect_list(F.struct("term_number", gain.alias("gain"))).alias("postings"))
    )
    keyed = ", ".join(f"`{k}` {passages.schema[k].dataType.simpleString()}" for k in m.keys)
    best = passages.mapInArrow(_best_passages(held, len(classes), m.keys, limit), f"class_of_query int, {keyed}, score double")
    front = Window.partitionBy("class_of_query").orderBy(F.desc("score"), *m.keys)
    ranked = best.withColumn("lexical_rank", F.row_number().over(front)).where(F.col("lexical_rank") <= limit)
    hits = ranked.join(F.broadcast(named), "class_of_query")
    return hits.select(*m.keys, m.query_id, "score", "lexical_rank")


# Scores that a task holds at a time.
_CELLS = 1 << 21


def _best_passages(held, classes: int, keys: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pair_class = held.value
        reach = np.zeros(classes)
        kept: list[pa.Table] = []
        waiting = 0

        def settled() -> pa.Table:
            """The best ``limit`` of each class among what was kept; raises the scores to reach."""
            order = [("class_of_query", "ascending"), ("score", "descending"), *[(k, "ascending") for k in keys]]
            table = pa.concat_tables(kept).sort_by(order)
            c = table["class_of_query"].to_numpy()
            place = np.arange(len(c)) - np.searchsorted(c, c)
            score = table["score"].to_numpy()
            last = place == limit - 1
            reach[c[last]] = np.maximum(reach[c[last]], score[last])
            return table.filter(pa.array(place < limit))

        for batch in batches:
            size = max(1, _CELLS // max(classes, 1))
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                postings = part.column("postings")
                of_row = pc.list_parent_indices(postings).to_numpy()
                flat = postings.flatten()
                term = flat.field("term_number").to_numpy().astype(np.int64)
                gain = flat.field("gain").to_numpy()
                # One entry per posting and class that has its term, a bounded number at a time.
                width = first[term + 1] - first[term]
                scores = np.zeros(part.num_rows * classes)
                ends = np.cumsum(width)
                cuts = [0, *np.searchsorted(ends, np.arange(_CELLS, ends[-1] if len(ends) else 0, _CELLS)).tolist(), len(term)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    w = width[a:b]
                    inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                    cell = np.repeat(of_row[a:b] * classes, w) + pair_class[np.repeat(first[term[a:b]], w) + inside]
                    scores += np.bincount(cell, weights=np.repeat(gain[a:b], w), minlength=len(scores))
                scores = np.round(scores, 9).reshape(part.num_rows, classes)
                if part.num_rows > limit:
                    # So many rows of this block reach its own weakest one among the best.
                    reach = np.maximum(reach, np.partition(scores, -limit, axis=0)[-limit])
                row, cls = np.nonzero((scores >= reach) & (scores > 0))
                if not len(row):
                    continue
                found = {"class_of_query": pa.array(cls.astype(np.int32))}
                found |= {k: part.column(k).take(pa.array(row)) for k in keys}
                kept.append(pa.table(found | {"score": scores[row, cls]}))
                waiting += len(row)
                # Often at first, while the scores to reach are low.
                if waiting > max(4 * limit * classes, 100_000):
                    kept = [settled()]
                    waiting = 0
        if kept:
            yield from settled().to_batches()

    return run


def coverage(m: KeywordMatches, queries: DataFrame) -> DataFrame:
    """Per query: matched_terms, query_terms and the idf-weighted share of terms that occur."""
    per_query = (
        _weights(m)
        .groupBy(m.query_id)
        .agg(
            F.count_if(F.col("df") > 0).alias("matched_terms"),
            F.count("*").alias("query_terms"),
            F.sum(F.when(F.col("df") > 0, F.col("idf")).otherwise(0.0)).alias("matched_idf"),
            F.sum("idf").alias("total_idf"),
            F.max("chunks").alias("chunk_count"),
        )
    )
    share = F.coalesce(F.try_divide(F.col("matched_idf"), F.col("total_idf")), F.lit(0.0))
    return (
        queries.select(m.query_id)
        .join(per_query, m.query_id, "left")
        .select(
            m.query_id,
            F.coalesce("matched_terms", F.lit(0)).alias("matched_terms"),
            F.coalesce("query_terms", F.lit(0)).alias("query_terms"),
            share.alias("weighted_coverage"),
            "chunk_count",
        )
    )


def should_abstain(semantic_used, query_terms_n, matched_terms, chunk_count):
    """True only for keyword search over a long text with searchable terms of which none occurs."""
    return ~semantic_used & (query_terms_n > 0) & (chunk_count >= MIN_CHUNKS_TO_GATE) & (matched_terms == 0)


def fuse(lexical: DataFrame, semantic: DataFrame, keys: list[str], query_id: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion with each ranker's best ``GUARANTEED`` passages in front.

    Both inputs hold at most ``CANDIDATES`` rows per query, so everything here is small per query.
    Ties go to keyword hits in rank order, then vector hits in rank order.
    """
    on = [query_id, *keys]
    both = lexical.select(*on, "score", "lexical_rank").join(
        semantic.select(*on, "similarity", "semantic_rank"), on, "full_outer"
    )
    part = lambda rank: F.coalesce(1.0 / (RRF_K + F.col(rank)), F.lit(0.0))
    entered = F.coalesce(F.col("lexical_rank"), F.col("semantic_rank") + CANDIDATES)
    scored = both.select(
        *on,
        F.coalesce("score", F.lit(0.0)).alias("lexical"),
        F.col("similarity").alias("semantic"),
        "lexical_rank",
        "semantic_rank",
        F.round(part("lexical_rank") + part("semantic_rank"), 12).alias("rrf"),
        entered.alias("entered"),
    )
    per_query = Window.partitionBy(query_id)
    ranked = scored.withColumn("rrf_rank", F.row_number().over(per_query.orderBy(F.desc("rrf"), "entered")))
    # Ranks inside the fused list: equal scores keep the fused order.
    ranked = ranked.withColumn(
        "lex_pos", F.when(F.col("lexical") > 0, F.row_number().over(per_query.orderBy(F.desc("lexical"), "rrf_rank")))
    ).withColumn(
        "sem_pos",
        F.when(
            F.col("semantic").isNotNull(),
            F.row_number().over(per_query.orderBy(F.desc_nulls_last("semantic"), "rrf_rank")),
        ),
    )
    slot = F.least(
        F.when(F.col("lex_pos") <= GUARANTEED, 2 * F.col("lex_pos") - 1),
        F.when(F.col("sem_pos") <= GUARANTEED, 2 * F.col("sem_pos")),
        1000 + F.col("rrf_rank"),
    )
    return ranked.withColumn("final_rank", F.row_number().over(per_query.orderBy(slot))).drop("lex_pos", "sem_pos")
