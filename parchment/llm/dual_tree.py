"""Ranked lexical search by dual trees: the best documents of every item, exactly, without scoring all pairs.

A stored index holds every document's terms. Queries are put in blocks of bounded size. In each task the
documents at hand are ordered so that like ones are neighbours; ``FAN`` neighbours form a node that keeps, for
every term, the largest impact among them, and nodes form nodes up to one root. The items of the block
form a tree in the same way, with the weights of their terms. A search walks pairs of nodes downwards: the
sum of weight times impact over the item node's terms bounds every score below the pair, and where it is
less than the weakest 50th score of the items below, the whole batch of pairs is dropped.

Scores that bound the rest come early: documents are searched in ``ROUNDS`` slices, a small one first,
and the 50th scores of one round are where the next one starts. So a task passes on only rows that
could still be among the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import checkpoint
from parchment.session import fits_broadcast, work_dir

TOP = 50
FAN = 8
ITEM_FAN = 4
# One of so many documents is searched in each round; the last round takes all that are left.
ROUNDS = (4096, 64, 1)
# Terms of items in one block of queries, and postings of documents under one tree in a task.
BLOCK_TERMS = 1_000_000
TREE_POSTINGS = 1_000_000
PAIRS = 20_000

_KEPT = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_KEPT).split()


def _counted(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else vocabulary.value
        for batch in batches:
            n, sizes, flat, tfs = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms(text)
                found = Counter(words)
                if known is not None:
                    found = {t: c for t, c in found.items() if t in known}
                n.append(len(words))
                sizes.append(len(found))
                flat += found
                tfs += found.values()
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            words = pa.array(flat, pa.binary()).cast(pa.string())
            columns = [batch.column(0), pa.array(n, pa.int64())]
            columns += [pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tfs"])

    return run


def counted(rows: DataFrame, id_column: str, vocabulary=None) -> DataFrame:
    """id, n (terms with repeats), terms and tfs of every row's ``text``; terms outside the broadcast
    ``vocabulary`` count in n only."""
    kind = dict(rows.dtypes)[id_column]
    read = rows.select(F.col(id_column).alias("id"), "text")
    return read.mapInArrow(_counted(vocabulary), f"id {kind}, n long, terms array<string>, tfs array<long>")


class Tree:
    """Levels of nodes over vectors: per level the terms of each node and their largest values.

    Vectors are given as rows of (vector, term, value), by vector; level 0 is the vectors themselves.
    """

    def __init__(self, vector: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, width: int, fan: int):
        self.width, self.fan = width, fan
        key = vector * width + term
        order = np.argsort(key, kind="stable")
        self.keys, self.values, self.sizes = [key[order]], [value[order]], [size]
        while self.sizes[-1] > 1:
            key = self.keys[-1] // width // fan * width + self.keys[-1] % width
            order = np.argsort(key, kind="stable")
            key, value = key[order], self.values[-1][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            self.keys.append(key[first])
            self.values.append(np.maximum.reduceat(value, first) if len(key) else value)
            self.sizes.append(-(-self.sizes[-1] // fan))
        self.starts = [np.searchsorted(k, np.arange(n + 1) * width) for k, n in zip(self.keys, self.sizes)]

    @property
    def top(self) -> int:
        return len(self.sizes) - 1

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per child of ``nodes``: which of them is its parent, and its own number one level below."""
        first = nodes * self.fan
        n = np.minimum(first + self.fan, self.sizes[level - 1]) - first
        parent = np.repeat(np.arange(len(nodes)), n)
        return parent, first[parent] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def bounds(items: Tree, item_level: int, docs: Tree, doc_level: int, i: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sum of weight times impact over the terms of each pair of nodes: the largest score of any pair below,
    at level 0 of both the score itself."""
    out = np.zeros(len(i), np.int64)
    keys, values = docs.keys[doc_level], docs.values[doc_level]
    begin, end = items.starts[item_level][i], items.starts[item_level][i + 1]
    n = end - begin
    used = np.flatnonzero(n)
    if not len(used) or not len(keys):
        return out
    n, begin = n[used], begin[used]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    wanted = np.repeat(d[used], n) * docs.width + items.keys[item_level][at] % items.width
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    part = np.where(keys[found] == wanted, values[found], 0) * items.values[item_level][at]
    out[used] = np.add.reduceat(part, np.cumsum(n) - n)
    return out


class Best:
    """The best documents per item seen by a task, and the scores a document has to reach."""

    def __init__(self, start: np.ndarray, top: int):
        self.start, self.top = start, top
        self.reach = start.copy()
        self.item = np.zeros(0, np.int64)
        self.score, self.doc, self.null = self.item, self.item, np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        good = (score > 0) & (score >= self.reach[item])
        if not good.any():
            return
        item, score = np.r_[self.item, item[good]], np.r_[self.score, score[good]]
        doc, null = np.r_[self.doc, doc[good]], np.r_[self.null, null[good]]
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        keep = rank < self.top
        order = order[keep]
        self.item, self.score, self.doc, self.null = item[keep], score[order], doc[order], null[order]
        last = rank[keep] == self.top - 1
        self.reach[self.item[last]] = np.maximum(self.start[self.item[last]], self.score[last])


def search(items: Tree, docs: Tree, doc: np.ndarray, null: np.ndarray, best: Best, seen: Counter | None = None) -> None:
    """Adds the documents' best scores to ``best``; ``seen`` counts the bounds worked out per pair of levels."""
    if not items.sizes[0] or not docs.sizes[0]:
        return
    root = np.zeros(1, np.int64)
    todo = [(items.top, docs.top, root, root, bounds(items, items.top, docs, docs.top, root, root))]
    while todo:
        li, ld, i, d, bound = todo.pop()
        weakest = best.reach
        for _ in range(li):
            weakest = np.minimum.reduceat(weakest, np.arange(0, len(weakest), items.fan))
        open_ = (bound > 0) & (bound >= weakest[i])
        i, d, bound = i[open_], d[open_], bound[open_]
        if not len(i):
            continue
        if not li and not ld:
            best.add(i, bound, doc[d], null[d])
            continue
        if li and (li >= ld or not ld):
            parent, i = items.children(li, i)
            d, li = d[parent], li - 1
        else:
            parent, d = docs.children(ld, d)
            i, ld = i[parent], ld - 1
        # The deeper a pair is, the more terms it has been checked for: the most promising ones go first.
        for k in reversed(range(0, len(i), PAIRS)):
            a, b = i[k : k + PAIRS], d[k : k + PAIRS]
            bound = bounds(items, li, docs, ld, a, b)
            if seen is not None:
                seen[li, ld] += len(a)
            order = np.argsort(-bound, kind="stable")
            todo += [(li, ld, a[o], b[o], bound[o]) for o in reversed(np.array_split(order, -(-len(order) // 2_000)))]


class Block:
    """One block of items: their terms, numbered, and the tree over them."""

    def __init__(self, held: list[tuple[object, list[str]]]):
        self.ids = [x for x, _ in held]
        self.vocabulary = {t.encode(): k for k, t in enumerate(sorted({t for _, ts in held for t in ts}))}
        self.terms = [sorted(self.vocabulary[t.encode()] for t in ts) for _, ts in held]

    def weigh(self, df: dict[bytes, int], n_docs: int) -> None:
        self.weight = np.array(
            [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in self.vocabulary], np.int64
        )
        # Items are neighbours that share their heaviest terms.
        order = sorted(range(len(self.terms)), key=lambda k: sorted(((-self.weight[t], t) for t in self.terms[k])))
        self.order = np.array(order, np.int64)
        term = np.array([t for k in order for t in self.terms[k]], np.int64)
        item = np.repeat(np.arange(len(order)), [len(self.terms[k]) for k in order]).astype(np.int64)
        self.tree = Tree(item, term, self.weight[term], len(order), max(len(self.vocabulary), 1), ITEM_FAN)


def doc_tree(block: Block, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int):
    """The tree over documents given as flat postings, and the documents in the order of its leaves."""
    m = 50 + 50 * n * n_docs // max(n_terms, 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
    worth = impact * block.weight[term]
    by_worth = np.lexsort((term, -worth, doc))
    starts = np.cumsum(sizes) - sizes
    lead = [np.full(len(sizes), -1), np.full(len(sizes), -1)]
    for k in (0, 1):
        has = sizes > k
        lead[k][has] = term[by_worth[starts[has] + k]]
    order = np.lexsort((n, lead[1], lead[0]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Tree(place[doc], term, impact, len(sizes), block.tree.width, FAN), order


def _searching(shared, top: int, n_docs: int, n_terms: int, start: np.ndarray, tree_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = Best(start[block.order], top)
        held: list[tuple] = []

        def work() -> None:
            ids, null, sizes, term, tf, n = (np.concatenate(x) for x in zip(*held))
            tree, order = doc_tree(block, sizes, term, tf, n, n_docs, n_terms)
            search(block.tree, tree, ids[order], null[order], best)

        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                lists = part.column(2)
                flat = lists.flatten().cast(pa.binary()).dictionary_encode()
                known = np.array([block.vocabulary.get(t, -1) for t in flat.dictionary.to_pylist()] or [-1], np.int64)
                term = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                kept = term >= 0
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)[kept]
                sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
                some = sizes > 0
                ids = part.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                n = part.column(1).to_numpy(zero_copy_only=False)
                held.append((ids[some], null[some], sizes[some], term[kept], tf, n[some]))
                size += len(tf)
                if size >= tree_postings:
                    work()
                    held, size = [], 0
        if held:
            work()
        columns = [pa.array(block.order[best.item]), pa.array(best.doc, mask=best.null), pa.array(best.score)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, block_terms: int) -> Iterator[Block]:
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row["id"], row["terms"]))
        size += len(row["terms"]) + 1
        if size >= block_terms:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows per item with their rank; tasks pass on no more than that."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, tree_postings: int = TREE_POSTINGS
) -> DataFrame:
    """For each row of ``items`` (item_id, text) its ``top`` highest-scoring rows of ``docs`` (doc_id, an integer,
    and text): item_id, rank (from 1), doc_id, score.

    Only scores above 0; equal scores by ascending doc_id, a null id last. A null text has no terms. Every
    row of ``items`` is an item of its own, also where it has no id or repeats one; an item without terms or
    without hits has no rows. Rows of ``docs`` that repeat an id rank one by one. Other columns are not
    read. An empty table on either side gives an empty result. The items come to the driver in
    blocks of ``block_terms`` terms; each block is one pass over the index, not over the texts.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    asked = checkpoint(counted(items, "item_id"))
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    vocabulary = None
    if fits_broadcast(wanted):
        vocabulary = context.broadcast(frozenset(r.term.encode() for r in wanted.toLocalIterator()))
    folder = work_dir(spark, "dual-tree")
    in_round = F.lit(len(ROUNDS) - 1)
    for k in reversed(range(len(ROUNDS) - 1)):
        in_round = F.when(F.pmod(F.xxhash64("id"), F.lit(ROUNDS[0])) < ROUNDS[0] // ROUNDS[k], k).otherwise(in_round)
    counted(docs, "doc_id", vocabulary).withColumn("round", in_round).write.partitionBy("round").parquet(folder)
    schema = f"id {dict(docs.dtypes)['doc_id']}, n long, terms array<string>, tfs array<long>, round int"
    index = spark.read.schema(schema).parquet(folder)
    totals = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = None
    for block in _blocks(asked.where(F.size("terms") > 0).select("id", "terms"), block_terms):
        own = spark.createDataFrame([(t.decode(),) for t in block.vocabulary], "term string")
        # As many rows as the block has terms at most.
        block.weigh({r.term.encode(): r.df for r in frequency.join(F.broadcast(own), "term").collect()}, n_docs)
        shared = context.broadcast(block)
        start, found = np.zeros(len(block.ids), np.int64), None
        for k in range(len(ROUNDS)):
            part = index.where(F.col("round") == k).drop("round")
            run = _searching(shared, top, n_docs, n_terms, start, tree_postings)
            rows = part.mapInArrow(run, "item long, doc_id long, score long")
            rows = rows if found is None else rows.unionByName(found.drop("rank"))
            found = checkpoint(_best(rows, top))
            if k < len(ROUNDS) - 1:
                for r in found.where(F.col("rank") == top).select("item", "score").collect():
                    start[r.item] = r.score
        kind = items.schema["item_id"].dataType.simpleString()
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {kind}")
        named = found.join(F.broadcast(names), "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "score"
        )
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long")
    return out
