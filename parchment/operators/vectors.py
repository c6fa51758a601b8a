"""Exact vector search: query vectors visit the passages, never the other way round.

Each Arrow batch of passages is scored against blocks of query vectors with matrix products. A task
keeps the best rows and the sums of every query over all its batches and gives them up once, so no pair
table is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATES = 20
# Query vectors of one matrix product, and blocks of one pass over the passages: 16,000 vectors of
# 384 dimensions are 49 MB for every executor. Further queries take further passes.
QUERY_BLOCK = 2000
PASS_BLOCKS = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, 1.0).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    lengths[lengths == 0] = 1.0
    return rows / lengths


def _scorer(blocks, keys: list[str], vector: str, query_id: str, limit: int):
    """Best rows and sums per query over all batches of a task, given up once at its end."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [
            {
                "score": np.empty((0, len(ids))),
                "keys": [np.empty((0, len(ids)), np.int64) for _ in keys],
                "n": 0,
                "total": np.zeros(len(ids)),
                "squares": np.zeros(len(ids)),
            }
            for ids, _ in blocks.value
        ]
        for batch in batches:
            batch = batch[batch[vector].notna()]
            if batch.empty:
                continue
            rows = _unit(np.stack(batch[vector].to_numpy()).astype("float64"))
            own = [batch[k].to_numpy().astype(np.int64) for k in keys]
            by_key = np.lexsort(own[::-1])
            rows, own = rows[by_key], [k[by_key] for k in own]
            for (ids, matrix), top in zip(blocks.value, held, strict=True):
                scores = rows @ matrix.T
                top["n"] += len(rows)
                top["total"] += scores.sum(axis=0)
                top["squares"] += (scores * scores).sum(axis=0)
                scores = np.round(scores, 9)
                # Ties at the cut go to the lower key, as in the final ranking.
                best = np.argsort(-scores, axis=0, kind="stable")[:limit]
                values = np.concatenate([top["score"], np.take_along_axis(scores, best, axis=0)])
                named = [np.concatenate([old, new[best]]) for old, new in zip(top["keys"], own, strict=True)]
                order = np.lexsort((*named[::-1], -values), axis=0)[:limit]
                top["score"] = np.take_along_axis(values, order, axis=0)
                top["keys"] = [np.take_along_axis(k, order, axis=0) for k in named]
        for (ids, _), top in zip(blocks.value, held, strict=True):
            if not top["n"]:
                continue
            kept = len(top["score"])
            out = pd.DataFrame({k: v.T.ravel() for k, v in zip(keys, top["keys"], strict=True)}).astype("Int64")
            out[query_id] = np.repeat(np.asarray(ids), kept)
            out["similarity"] = top["score"].T.ravel()
            out["n"], out["total"], out["squares"] = 0, 0.0, 0.0
            sums = pd.DataFrame({k: pd.Series([None] * len(ids), dtype="Int64") for k in keys})
            sums[query_id], sums["similarity"] = ids, np.nan
            sums["n"], sums["total"], sums["squares"] = top["n"], top["total"], top["squares"]
            yield pd.concat([out, sums], ignore_index=True)

    return score


def _query_blocks(queries: DataFrame, query_id: str, vector: str, block: int, blocks: int) -> Iterator[list[tuple[list, np.ndarray]]]:
    """Groups of at most ``blocks`` blocks of query vectors, ordered by id; one group is one pass."""
    last, group = None, []
    while True:
        part = queries.where(F.col(vector).isNotNull())
        if last is not None:
            part = part.where(F.col(query_id) > last)
        rows = part.select(query_id, vector).orderBy(query_id).limit(block).collect()
        if rows:
            group.append(([r[0] for r in rows], _unit(np.array([r[1] for r in rows], dtype="float64"))))
            last = rows[-1][0]
        if group and (len(group) == blocks or len(rows) < block):
            yield group
            group = []
        if len(rows) < block:
            return


def vector_search(
    passages: DataFrame,
    queries: DataFrame,
    keys: list[str],
    vector: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "vector",
    limit: int = CANDIDATES,
    block: int = QUERY_BLOCK,
    blocks: int = PASS_BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """(top passages per query, per-query mean, std and z-score of the best).

    ``keys`` and the query id are whole numbers. Query ids are unique. One pass over the passages
    serves ``block`` x ``blocks`` queries; a task passes on ``limit`` rows and one row of sums per query.
    """
    source = passages.select(*keys, vector)
    schema = T.StructType(
        [T.StructField(k, T.LongType()) for k in keys]
        + [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("n", T.LongType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("squares", T.DoubleType()),
        ]
    )
    context = queries.sparkSession.sparkContext
    scored = None
    for group in _query_blocks(queries, query_id, query_vector, block, blocks):
        part = source.mapInPandas(_scorer(context.broadcast(group), keys, vector, query_id, limit), schema)
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        scored = queries.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"), *keys)
    top = (
        scored.where(F.col("similarity").isNotNull())
        .withColumn("semantic_rank", F.row_number().over(best))
        .where(F.col("semantic_rank") <= limit)
        .drop("n", "total", "squares")
    )
    sums = scored.groupBy(query_id).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("squares").alias("squares"),
        F.max(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("best"),
    )
    mean = F.col("total") / F.col("n")
    std = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    stats = sums.select(query_id, "n", "best", mean.alias("mean"), std.alias("std")).withColumn(
        "z", F.when(F.col("std") > 1e-6, (F.col("best") - F.col("mean")) / F.col("std")).otherwise(0.0)
    )
    return top, stats


def relevance_issue(answer_similarity: Column, best_passage_similarity: Column, ratio: float = 0.95) -> Column:
    """Ratio (two decimals) when an answer is less related to its question than the best passage."""
    share = answer_similarity / best_passage_similarity
    return F.when(best_passage_similarity > 0, F.when(share < ratio, F.round(share, 2) + 0.0))  # never -0.0
