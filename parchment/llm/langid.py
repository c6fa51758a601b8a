"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed character n-grams (1 to 3 letters, word edges included) of
unit length. Each language has several centroids from spherical k-means; a text takes the language
of the centroid with the largest cosine. A text too far from its nearest centroid is rejected.

Document frequencies are counted over every training row. Only the clustering runs on a sample of at most
``SAMPLE`` rows per language, chosen by a hash of the row and turned into vectors where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import checkpoint, drop_rows, fold, text_key

DIMS = 4096
CLUSTERS = 4
SAMPLE = 600
MAX_LANGUAGES = 1000
# A text is rejected below this share of the cosine that 99 % of its language's sample reach.
REJECT = 0.5
BLOCK_CHARS, BLOCK_TEXTS = 400_000, 200
BUCKETS = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(t or "")
        if n >= BLOCK_CHARS or len(held) >= BLOCK_TEXTS:
            yield held
            held, n = [], 0
    if held:
        yield held


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x DIMS) and letters of each text."""
    lines = [" " + t.lower() + " " for t in texts]
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    letter = _letters()[code]
    n_letters = np.bincount(doc[letter], minlength=len(lines))
    code = np.where(letter, code, 32)
    # A run of other characters is one space; each text begins with one.
    keep = letter | np.r_[True, letter[:-1] | (doc[1:] != doc[:-1])]
    code, doc, letter = code[keep].astype(np.uint64), doc[keep], letter[keep]
    out = np.zeros(len(lines) * DIMS)
    gram = np.zeros(len(code), np.uint64)
    any_letter = np.zeros(len(code), bool)
    for n in (1, 2, 3):
        if len(code) < n:
            break
        size = len(code) - n + 1
        gram = gram[:size] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        any_letter = any_letter[:size] | letter[n - 1 :]
        ok = any_letter & (doc[:size] == doc[n - 1 :])
        slot = ((gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % DIMS
        out += np.bincount(doc[:size][ok] * DIMS + slot[ok], minlength=len(out))
    return out.reshape(-1, DIMS), n_letters


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n).astype(np.float32) * idf
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def _bucket(letters: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(letters, 1))).astype(int).clip(0, BUCKETS - 1)


@dataclass
class Model:
    """langs: the language of each centroid; floors: least cosine by centroid and size of the text."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, rejected = [], [], []
        for block in _blocks(texts):
            n, letters = counts(block)
            if not self.langs:
                best, near = np.zeros(len(block), int), np.zeros(len(block))
                known = np.zeros(len(block), bool)
            else:
                cosine = vectors(n, self.idf) @ self.centroids.T
                best = cosine.argmax(axis=1)
                near = cosine[np.arange(len(block)), best].clip(0, 1)
                known = letters > 0
            far = near < (self.floors[best, _bucket(letters)] if self.langs else 1)
            lang += [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            score += np.where(known, near, 0.0).tolist()
            rejected += (far | ~known).tolist()
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, np.int64)
    for batch in batches:
        for block in _blocks(batch.column(0).to_pylist()):
            total += (counts(block)[0] > 0).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(total)], ["dim", "n"])


def _sample_vectors(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for block in _blocks(texts):
                n, letters = counts(block)
                rows = [v.tobytes() for v in vectors(n, idf.value)]
                own = langs[at : at + len(block)]
                at += len(block)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(letters.astype(np.int64)), pa.array(rows, pa.binary())], ["lang", "letters", "vector"])

    return run


def _cluster(rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means of one language's sample, and the low quantile of the cosines by text size."""
    rows = rows[rows["letters"] > 0]
    if rows.empty:
        return pd.DataFrame({"lang": [], "cluster": [], "centroid": [], "floors": []})
    rows = rows.sort_values("vector")  # the result must not depend on the order of arrival
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["vector"]])
    rng = np.random.default_rng(7)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < min(CLUSTERS, len(x)):
        apart = (1 - (x @ centres.T).max(axis=1)).clip(0) + 1e-9
        centres = np.vstack([centres, x[rng.choice(len(x), p=apart / apart.sum())]])
    for _ in range(15):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    cosine, bucket = (x @ centres.T).max(axis=1), _bucket(rows["letters"].to_numpy())
    floors = np.full(BUCKETS, np.nan)
    for b in range(BUCKETS):
        if (bucket == b).sum() >= 20:
            floors[b] = np.quantile(cosine[bucket == b], 0.01)
    seen = np.flatnonzero(~np.isnan(floors))
    if len(seen):
        # Longer texts than seen are held to the longest seen; the cosine of shorter ones falls with the root of their size.
        floors = np.interp(np.arange(BUCKETS), seen, floors[seen])
        floors[: seen[0]] *= 2.0 ** ((np.arange(seen[0]) - seen[0]) / 2)
    else:
        floors = np.full(BUCKETS, 0.0)
    lang = rows["lang"].iloc[0]
    return pd.DataFrame(
        {
            "lang": lang,
            "cluster": np.arange(len(centres), dtype=np.int32),
            "centroid": [c.astype(np.float32).tobytes() for c in centres],
            "floors": [(floors * REJECT).tolist()] * len(centres),
        }
    )


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``rows`` (doc_id, text, lang); rows with a null text or lang are passed over.

    ``sample`` bounds the rows per language that are clustered; document frequencies count all rows.
    Of more than ``MAX_LANGUAGES`` values of lang, as a dirty column has, the most frequent are learned.
    """
    spark = rows.sparkSession
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    by_lang = checkpoint(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    total = by_lang.agg(F.sum("n")).first()[0]
    sizes = {r.lang: r.n for r in by_lang.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return Model(np.ones(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32), np.zeros((0, BUCKETS)))
    per_task = rows.select("text").mapInArrow(_document_frequencies, "dim int, n long")
    df = np.zeros(DIMS)
    for r in per_task.groupBy("dim").agg(F.sum("n").alias("n")).collect():  # DIMS rows
        df[r.dim] = r.n
    idf = (np.log((total + 1) / (df + 1)) + 1).astype(np.float32)
    # A share by hash first, then an exact bound; the order is the same whatever the partitions.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * sample / n))])
    point = F.xxhash64("doc_id", "text")
    few = rows.where(F.pmod(point, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).withColumn("point", point)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("point"))).where(F.col("place") <= sample)
    drawn = few.select("lang", "text").mapInArrow(_sample_vectors(spark.sparkContext.broadcast(idf)), "lang string, letters long, vector binary")
    made = drawn.groupBy("lang").applyInPandas(_cluster, "lang string, cluster int, centroid binary, floors array<double>")
    found = sorted(made.collect(), key=lambda r: (r.lang, r.cluster))  # CLUSTERS rows per language
    if not found:
        return Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros((0, BUCKETS)))
    return Model(idf, [r.lang for r in found], np.stack([np.frombuffer(r.centroid, np.float32) for r in found]), np.array([r.floors for r in found]))


_RESULT = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)


def predictor(spark, model: Model):
    """Column function text -> struct(lang_pred, score, rejected)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield sent.value.predict(texts.tolist())

    return predict


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows of ``docs`` (doc_id, text, lang) outside the held-out fold and predicts all.

    Columns: doc_id, held_out (crc32 of doc_id as text modulo ``folds`` is ``held_out``; a null id
    counts as empty text), lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected. A null
    text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if nothing
    can be learned. Equal cosines go to the first language in alphabetical order. Repeated rows each
    get a row; other columns are not read; an empty table gives an empty result.
    """
    mark = fold(F.col("doc_id"), folds) == held_out
    model = fit(docs.where(~mark), sample)
    predict = predictor(docs.sparkSession, model)
    rows = docs.select("doc_id", mark.alias("held_out"), predict("text").alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def recognised(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that are rejected, all columns as they were."""
    mark = fold(F.col("doc_id"), folds) == held_out
    predict = predictor(docs.sparkSession, fit(docs.where(~mark), sample))
    rows = docs.select("doc_id", text_key(F.coalesce(F.col("text"), F.lit(""))).alias("key_text"), predict("text").alias("p"))
    return drop_rows(docs, rows.where("p.rejected").select(F.col("doc_id").alias("key_id"), "key_text"))
