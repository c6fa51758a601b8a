"""Vectors in stored clusters: exact search that opens only clusters which can hold a best row.

Centres are fitted on a bounded sample; every passage goes to its nearest centre, and a cluster is known by its
centre and its radius, the largest angle to it. No row of a cluster is nearer to a query than the angle to the
centre less the radius, so clusters whose bound is below a query's weakest best score stay closed. Mean and
deviation of a query's scores over the whole corpus follow from the number of passages, their sum vector and
their second-moment matrix; no pair is scored for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.operators.vectors import CANDIDATES, QUERY_BLOCK, _query_blocks, _unit
from parchment.session import stored

# Rows the centres are fitted on, and the most centres there may be: 4,096 of 384 dimensions are 13 MB.
SAMPLE = 10_000
MAX_CLUSTERS = 4_096
ROUNDS = 8
# Rounding of an angle close to zero.
SLACK = 1e-6


def fit_centres(rows: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Unit centres of at most ``k`` clusters by cosine."""
    rows = np.unique(_unit(rows), axis=0)
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        held = np.bincount(near, minlength=len(centres)) > 0
        centres = _unit(np.where(held[:, None], sums, centres))
    return centres


def _assigned(centres, keys: list[str], vector: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _unit(np.stack(batch[vector].to_numpy()).astype("float64"))
            near = rows @ centres.value.T
            out = batch[keys].copy()
            out["cluster"] = near.argmax(axis=1)
            out["angle"] = np.arccos(np.clip(near.max(axis=1), -1.0, 1.0))
            out["vector"] = list(rows)
            yield out

    return run


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of a task: row -1 the sum vector, the others the second moments."""
    total = None
    for batch in batches:
        rows = np.stack(batch["vector"].to_numpy())
        own = np.vstack([rows.sum(axis=0, keepdims=True), rows.T @ rows])
        total = own if total is None else total + own
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total)) - 1, "sums": list(total)})


def _scored(shared, keys: list[str], limit: int):
    """Best rows per query of a task, of the clusters that each query has open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, open_ = shared.value
        best = pd.DataFrame({"q": np.zeros(0, np.int64), "similarity": np.zeros(0), **{k: np.zeros(0, np.int64) for k in keys}})
        for batch in batches:
            found = [best]
            for cluster, part in batch.groupby("cluster"):
                asked = open_.get(cluster)
                if asked is None:
                    continue
                scores = np.round(np.stack(part["vector"].to_numpy()) @ queries[asked].T, 9)
                # No more than ``limit`` rows of a part can be among the best; ties stay in.
                cut = np.sort(scores, axis=0)[-min(limit, len(scores))]
                row, col = np.nonzero(scores >= cut)
                named = {k: part[k].to_numpy().astype(np.int64)[row] for k in keys}
                found.append(pd.DataFrame({"q": np.asarray(asked)[col], "similarity": scores[row, col], **named}))
            best = pd.concat(found, ignore_index=True).sort_values(["q", "similarity", *keys], ascending=[True, False] + [True] * len(keys))
            best = best.groupby("q").head(limit)
        yield best

    return run


@dataclass
class VectorIndex:
    spark: SparkSession
    folder: str
    keys: list[str]

    def build(self, passages: DataFrame, vector: str = "vector", clusters: int | None = None, sample: int = SAMPLE) -> None:
        """Stores the ``passages`` (keys, vector) in clusters. Keys are whole numbers; rows without a
        vector are left out, as in ``vector_search``."""
        rows = passages.where(F.col(vector).isNotNull()).select(*self.keys, vector)
        drawn = rows.orderBy(F.xxhash64(*self.keys)).limit(sample).select(vector).collect()
        if not drawn:
            centres = np.zeros((1, 1))
        else:
            count = clusters or int(min(MAX_CLUSTERS, max(1, len(drawn) // 64)))
            centres = fit_centres(np.array([r[0] for r in drawn], dtype="float64"), count)
        sent = self.spark.sparkContext.broadcast(centres)
        longs = [T.StructField(k, T.LongType()) for k in self.keys]
        schema = T.StructType(
            [*longs, T.StructField("cluster", T.LongType()), T.StructField("angle", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
        )
        placed = rows.mapInPandas(_assigned(sent, self.keys, vector), schema)
        # Ordered by cluster, so that files and row groups of closed ones are passed over; a large cluster is split.
        order = ["cluster", F.xxhash64(*self.keys)]
        placed.repartitionByRange(*order).sortWithinPartitions("cluster").write.mode("overwrite").parquet(f"{self.folder}/rows")
        placed = self._rows()
        radius = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        names = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cluster long, centre array<double>")
        radius.join(F.broadcast(names), "cluster").write.mode("overwrite").parquet(f"{self.folder}/clusters")
        sums = placed.select("vector").mapInPandas(_moments, "i long, sums array<double>")
        cells = sums.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
        cells.write.mode("overwrite").parquet(f"{self.folder}/moments")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def find(
        self, queries: DataFrame, query_id: str = "query_id", vector: str = "vector", limit: int = CANDIDATES, block: int = QUERY_BLOCK
    ) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
        """(top passages per query, statistics per query, (opened, all) pairs of query and cluster per block):
        the rows of ``vectors.vector_search``. Clusters and moments are read by the driver; their size is
        bounded by ``MAX_CLUSTERS`` and the dimensions. Each block of queries is two passes over its clusters."""
        known = self.spark.read.parquet(f"{self.folder}/clusters").orderBy("cluster").collect()
        cells = self.spark.read.parquet(f"{self.folder}/moments").collect()
        kind = queries.schema[query_id].dataType.simpleString()
        keys = ", ".join(f"{k} long" for k in self.keys)
        tops, stats, opened = [], [], []
        if known:
            sums = np.zeros((max(c.i for c in cells) + 2, max(c.j for c in cells) + 1))
            for c in cells:
                sums[c.i + 1, c.j] = c.x
            n = sum(r.n for r in known)
            names, sizes = np.array([r.cluster for r in known]), np.array([r.n for r in known])
            centres, radius = np.array([r.centre for r in known]), np.array([r.radius for r in known])
        for group in _query_blocks(queries, query_id, vector, block, 1) if known else ():
            ids, rows = group[0]
            angle = np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))
            bound = np.cos(np.maximum(angle - radius - SLACK, 0.0))
            order = np.argsort(-bound, axis=1, kind="stable")
            # The nearest clusters that hold enough rows to fill a result.
            ahead = np.cumsum(np.take_along_axis(np.broadcast_to(sizes, bound.shape), order, axis=1), axis=1)
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, np.c_[np.zeros(len(rows), np.int64), ahead[:, :-1]] < limit, axis=1)
            place = Window.partitionBy("q").orderBy(F.desc("similarity"), *self.keys)
            early = stored(self._open(rows, first, names, limit, keys), "vector-hits")
            reach = np.full(len(rows), -np.inf)
            ranked = early.withColumn("place", F.row_number().over(place)).where(F.col("place") == limit)
            for r in ranked.select("q", "similarity").collect():
                reach[r.q] = r.similarity
            late = (bound + SLACK >= reach[:, None]) & ~first
            opened.append((int(first.sum() + late.sum()), first.size))
            found = early.unionByName(self._open(rows, late, names, limit, keys)) if late.any() else early
            best = found.withColumn("semantic_rank", F.row_number().over(place)).where(F.col("semantic_rank") <= limit)
            mapping = self.spark.createDataFrame(list(enumerate(ids)), f"q long, {query_id} {kind}")
            tops.append(best.join(F.broadcast(mapping), "q").drop("q"))
            mean = rows @ sums[0] / n
            square = np.einsum("ij,jk,ik->i", rows, sums[1:], rows) / n
            std = np.sqrt(np.maximum(square - mean * mean, 0.0))
            own = self.spark.createDataFrame([(i, int(n), float(m), float(s)) for i, m, s in zip(ids, mean, std)], f"{query_id} {kind}, n long, mean double, std double")
            stats.append(own)
        if not tops:
            empty = self.spark.createDataFrame([], f"{keys}, similarity double, semantic_rank int, {query_id} {kind}")
            return empty, self.spark.createDataFrame([], f"{query_id} {kind}, n long, best double, mean double, std double, z double"), []
        top, stat = tops[0], stats[0]
        for t, s in zip(tops[1:], stats[1:]):
            top, stat = top.unionByName(t), stat.unionByName(s)
        best = top.where("semantic_rank = 1").select(query_id, F.col("similarity").alias("best"))
        z = F.when(F.col("std") > 1e-6, (F.col("best") - F.col("mean")) / F.col("std")).otherwise(0.0)
        return top, stat.join(best, query_id).withColumn("z", z).select(query_id, "n", "best", "mean", "std", "z"), opened

    def _open(self, queries: np.ndarray, pairs: np.ndarray, names: np.ndarray, limit: int, keys: str) -> DataFrame:
        """Best rows per query of the clusters in ``pairs`` (queries x clusters), and of no other."""
        used = np.flatnonzero(pairs.any(axis=0))
        asked = {int(names[c]): np.flatnonzero(pairs[:, c]) for c in used}
        shared = self.spark.sparkContext.broadcast((queries, asked))
        rows = self._rows().where(F.col("cluster").isin([int(names[c]) for c in used])).select(*self.keys, "cluster", "vector")
        return rows.mapInPandas(_scored(shared, self.keys, limit), f"q long, similarity double, {keys}")
