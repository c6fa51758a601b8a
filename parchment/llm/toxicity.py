"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the bag of its hashed character n-grams (3 to 5, word edges included) and itself, so an unseen
misspelling shares most vectors with the word it stands for. A passage of ``PASSAGE`` words is the
average of its subword vectors, a softmax over two classes scores it, and a text is as toxic as its
worst passage; the average over a long text would drown a few words.

Vectors and softmax are trained together in numpy. A label belongs to a whole text, so training begins
with every passage under the label of its text and goes on with only the worst passage of each toxic one. It
runs on at most ``SAMPLE`` labelled texts and ``SAMPLE_CHARS`` characters per class, drawn by a hash of the id; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import fold

SAMPLE = 1500
SAMPLE_CHARS = 4_000_000
SLOTS = 1 << 17
DIMS = 8
PASSAGE = 5
BLOCK_CHARS, BLOCK_TEXTS = 400_000, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _word_letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and passage of every subword, and the text of every passage."""
    lines = [" " + t.lower() + " " for t in texts]
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    letter = _word_letters()[code]
    keep = letter | np.r_[True, letter[:-1]]
    code, doc, letter = np.where(letter, code, 32)[keep].astype(np.uint64), doc[keep], letter[keep]
    first = letter & ~np.r_[False, letter[:-1]]
    if not first.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.cumsum(first) - 1
    owner = doc[first]
    begin = np.searchsorted(owner, owner)
    inside = (np.arange(len(owner)) - begin) // PASSAGE
    new = np.r_[True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])]
    passage = np.cumsum(new) - 1
    # The word itself: letters times a factor of their place.
    place = np.arange(len(code)) - np.flatnonzero(first)[np.maximum(word, 0)]
    spread = code * (_MIX * (2 * np.minimum(place, 255).clip(0).astype(np.uint64) + np.uint64(1)))
    whole = np.add.reduceat(spread[letter], np.searchsorted(np.flatnonzero(letter), np.flatnonzero(first)))
    slots, owners = [(whole * _MIX) >> np.uint64(40)], [passage]
    gap = np.cumsum(~letter)
    gram = code * _MIX
    for n in range(2, 6):
        size = len(code) - n + 1
        if size <= 0:
            break
        gram = (gram[:size] + np.uint64(n)) * _MIX + code[n - 1 :] * np.uint64(0xD6E8FEB86659FD93)
        if n > 2:
            ok = gap[n - 2 : n - 2 + size] == gap[:size]  # no gap behind the first letter and before the last
            slots.append((gram[ok] * _MIX) >> np.uint64(40))
            owners.append(passage[word[1 : size + 1][ok]])
    slot = (np.concatenate(slots) % np.uint64(SLOTS)).astype(np.int64)
    return slot, np.concatenate(owners), owner[new]


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


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Model:
    """weight: each slot's vector times the softmax difference; scale and shift: worst passage to score."""

    weight: np.ndarray
    bias: float
    scale: float
    shift: float
    floor: float

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """Largest passage logit of each text; the floor for one without words."""
        out = []
        for block in _blocks(texts):
            slot, passage, owner = subwords(block)
            top = np.full(len(block), self.floor)
            if len(owner):
                n = np.bincount(passage, minlength=len(owner))
                logit = np.bincount(passage, self.weight[slot], minlength=len(owner)) / n + self.bias
                np.maximum.at(top, owner, logit)
            out.append(top)
        return np.concatenate(out) if out else np.empty(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.scale * self.worst(texts) + self.shift)


def train(texts: list[str], toxic: np.ndarray, seed: int = 11) -> Model:
    """Vectors and softmax together by mini-batch gradient steps; with one class only, a constant."""
    share = float(np.mean(toxic)) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(SLOTS, np.float32), 0.0, 0.0, -50.0 if share == 0 else 50.0, 0.0)
    slots, passages, owners, n_pass, n_doc = [], [], [], 0, 0
    for block in _blocks(texts):
        s, p, o = subwords(block)
        slots.append(s.astype(np.int32))
        passages.append((p + n_pass).astype(np.int32))
        owners.append(o + n_doc)
        n_pass, n_doc = n_pass + len(o), n_doc + len(block)
    slot, passage, owner = np.concatenate(slots), np.concatenate(passages), np.concatenate(owners)
    order = np.argsort(passage, kind="stable")
    slot, passage = slot[order], passage[order]
    edge = np.searchsorted(passage, np.arange(n_pass + 1))
    size = np.diff(edge)
    rng = np.random.default_rng(seed)
    vector = rng.normal(0, 0.1, (SLOTS, DIMS)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, DIMS)).astype(np.float32)
    bias = np.zeros(2)
    label = toxic[owner].astype(float)

    def logits() -> np.ndarray:
        weight = vector @ (soft[1] - soft[0])
        return np.add.reduceat(weight[slot], edge[:-1]) / size + (bias[1] - bias[0])

    past = np.full(SLOTS, 1e-6)

    def epoch(use: np.ndarray, rate: float) -> None:
        nonlocal vector, soft, bias
        balance = np.where(label[use] > 0, 0.5 / max(1, (label[use] > 0).sum()), 0.5 / max(1, (label[use] == 0).sum())) * len(use)
        mix = rng.permutation(len(use))
        for at in range(0, len(mix), 512):
            pick = use[mix[at : at + 512]]
            n = size[pick]
            here = np.repeat(edge[pick], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = slot[here]
            starts = np.cumsum(n) - n
            mean = np.stack([np.add.reduceat(vector[own, d], starts) for d in range(DIMS)], axis=1) / n[:, None]
            diff = soft[1] - soft[0]
            error = (_sigmoid(mean @ diff + bias[1] - bias[0]) - label[pick]) * balance[mix[at : at + 512]]
            # Every subword of a passage has the same gradient: the error over the passage's size, along the difference.
            pull = np.bincount(own, np.repeat(error / n, n), minlength=SLOTS)
            hit = np.flatnonzero(pull)
            past[hit] += pull[hit] ** 2
            vector[hit] -= (rate * pull[hit] / np.sqrt(past[hit]))[:, None].astype(np.float32) * diff
            step = 0.1 * rate / len(pick) * (error @ mean)
            soft = soft + np.stack([step, -step]).astype(np.float32)
            bias = bias + 0.1 * rate / len(pick) * error.sum() * np.array([1, -1])

    everything = np.arange(n_pass)
    for _ in range(3):
        epoch(everything, 1.0)
    clean = np.flatnonzero(label == 0)
    for _ in range(9):
        score = logits()
        # The worst passage of each toxic text, all passages of the others.
        by = np.lexsort((-score, owner))
        worst = by[np.r_[True, owner[by][1:] != owner[by][:-1]]]
        epoch(np.concatenate([worst[label[worst] > 0], clean]), 1.0)
    score = logits()
    top = np.full(len(texts), score.min())
    np.maximum.at(top, owner, score)
    # One-dimensional logistic fit from the worst passage to the label of the text.
    mean, spread = top.mean(), top.std() + 1e-9
    x, a, b = (top - mean) / spread, 1.0, 0.0
    balance = np.where(toxic > 0, 0.3 / (toxic > 0).sum(), 0.7 / (toxic == 0).sum())
    for _ in range(2000):
        error = (_sigmoid(a * x + b) - toxic) * balance
        a, b = a - 4 * ((error * x).sum() + 1e-3 * a), b - 4 * error.sum()
    weight = (vector @ (soft[1] - soft[0])).astype(np.float32)
    return Model(weight, float(bias[1] - bias[0]), float(a / spread), float(b - a * mean / spread), float(score.min()))


def _train_task(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "toxic"])
    m = train(rows["text"].tolist(), rows["toxic"].to_numpy())
    return pd.DataFrame({"weight": [m.weight.astype(np.float32).tobytes()], "bias": m.bias, "scale": m.scale, "shift": m.shift, "floor": m.floor})


def training_texts(docs: DataFrame, labels: DataFrame, sample: int, sample_chars: int) -> DataFrame:
    """doc_id, text and toxic (0 or 1) of the texts of ``docs`` that ``labels`` (doc_id, toxic) names.

    At most ``sample`` texts per class, in the order of a hash of the id, and of them as many as
    ``sample_chars`` characters hold (or one text); texts with more than a hundredth of that come last, so a very
    long one leaves room for all others. Labels above 0 are toxic; ids with several labels count as toxic if
    any is; null labels are passed over.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # A share of each class by hash first, so that only about twice the sample is put in order.
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, 2.0 * sample / n))]) if sizes else None
    point = F.xxhash64("doc_id")
    few = known.where(F.pmod(point, F.lit(1_000_000)) < share[F.col("toxic")] * 1_000_000) if sizes else known
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    drawn = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    # 2 x sample ids of 16 bytes.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    once = texts.groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(F.length("text") > sample_chars // 100, "place"))
    bounded = once.withColumn("upto", upto).where((F.col("upto") <= sample_chars) | (F.col("upto") == F.length("text")))
    return bounded.select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from ``training_texts`` in one task."""
    made = training_texts(docs, labels, sample, sample_chars).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _train_task, "weight binary, bias double, scale double, shift double, floor double"
    ).collect()
    if not made:
        return train([], np.empty(0))
    m = made[0]
    return Model(np.frombuffer(m.weight, np.float32), m.bias, m.scale, m.shift, m.floor)


def scorer(spark, model: Model):
    """Column function text -> score."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.score(texts.tolist()))

    return score


def assess(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Learns from the labels outside the held-out fold and scores every row of ``docs`` (doc_id, text).

    Columns: doc_id, held_out (crc32 of doc_id as text modulo ``folds`` is ``held_out``; a null id
    counts as empty text), score (0 to 1), predicted (1 if score >= 0.5, else 0). Null and empty texts
    score like the mildest passage seen. With labels of one class, or none, every score is 1 or 0.
    Repeated rows each get a row; other columns are not read; an empty table gives an empty result.
    """
    learn = labels.where(fold(F.col("doc_id"), folds) != held_out)
    score = scorer(docs.sparkSession, fit(docs, learn, sample, sample_chars))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
