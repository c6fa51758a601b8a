"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each task turns its documents into segments, and a segment
holds, for every term, the sorted list of positions at which it stands. Segments are stored once
(``build_index``) and searched any number of times. A search starts from a query's rarest term by
corpus count, shifts its list by the term's offset in the query, and intersects it with the shifted
list of the next rarer term until the query is matched or no candidate is left. Queries come in
blocks of bounded size, one pass over the stored segments for each; postings are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import ascii_lower, checkpoint, drop_rows, text_key

WINDOW = 10
SEGMENT_WORDS = 500_000
SEGMENT_DOCS = 20_000
# Words of the queries that go to the tasks when an index is built for them only; with more, the
# index takes every word. 16 bytes a word: 32 MB.
VOCABULARY = 2_000_000
# Queries of one pass: at ten words of 16 bytes each, 8 MB.
BLOCK = 50_000
CANDIDATES = 2_000_000

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_INDEX = (
    "doc_ids array<long>, keys array<long>, starts array<int>, n_words array<int>, "
    "terms array<string>, offsets array<int>, positions array<int>"
)
_ARROW = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("n_words", pa.list_(pa.int32())),
     ("terms", pa.list_(pa.string())), ("offsets", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))]
)


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters a-z, digits and characters beyond ASCII; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and words of each distinct window of ``size`` consecutive words; an item with fewer
    words, but not none, is one window. Items without words have no window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size - 1), F.lit(1)))
    cut = w.select("item_id", F.explode(F.transform(starts, lambda p: F.slice("w", p, size))).alias("words"))
    return cut.distinct()


def _segments(vocabulary, segment_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = None if vocabulary is None else {w: k for k, w in enumerate(vocabulary.value)}
        own = {} if fixed is None else fixed
        ids, rows, at = [], [], 0

        def close() -> pa.RecordBatch:
            term = np.concatenate(ids) if ids else np.empty(0, np.int32)
            place = np.flatnonzero(term >= 0)
            term = term[place]
            seen = np.unique(term)
            term = np.searchsorted(seen, term)
            if len(seen) < 1 << 16:
                term = term.astype(np.uint16)
            order = np.argsort(term, kind="stable")
            names = list(own) if fixed is None else vocabulary.value
            one = {
                "doc_ids": [r[0] for r in rows],
                "keys": [r[1] for r in rows],
                "starts": [r[2] for r in rows],
                "n_words": [r[3] for r in rows],
                "terms": [names[k].decode() for k in seen],
                "offsets": np.r_[0, np.cumsum(np.bincount(term, minlength=len(seen)))].astype(np.int32),
                "positions": place[order].astype(np.int32),
            }
            return pa.RecordBatch.from_arrays([pa.array([one[f.name]], f.type) for f in _ARROW], schema=_ARROW)

        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(k) for k in range(3))):
                found = _WORD.findall((text.as_py() or b"").lower())
                rows.append((doc_id.as_py(), key.as_py(), at, len(found)))
                if fixed is None:
                    got = np.array([own.setdefault(w, len(own)) for w in found], np.int32)
                else:
                    got = np.fromiter(map(own.get, found, repeat(-1)), np.int32, len(found))
                # One empty place between documents: no phrase runs from one into the next.
                ids += [got, np.full(1, -1, np.int32)]
                at += len(found) + 1
                if at >= segment_words or len(rows) >= SEGMENT_DOCS:
                    yield close()
                    own = {} if fixed is None else fixed
                    ids, rows, at = [], [], 0
        if rows:
            yield close()

    return run


def build_index(docs: DataFrame, terms: DataFrame | None = None, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): one row per segment of about ``segment_words`` words.

    A segment lists its documents (id, text key, place of the first word, number of words) and, per
    term, the places where it stands. With ``terms`` (column ``term``) only these are kept: other
    words can't be part of a match. Above ``VOCABULARY`` terms all words are indexed. Null texts
    have no words.
    """
    spark = docs.sparkSession
    vocabulary = None
    if terms is not None:
        asked = [r.term.encode() for r in terms.select("term").distinct().limit(VOCABULARY + 1).collect()]
        if len(asked) <= VOCABULARY:
            vocabulary = spark.sparkContext.broadcast(sorted(asked))
    read = docs.select("doc_id", text_key(F.coalesce(F.col("text"), F.lit(""))).alias("key"), F.col("text").cast("binary").alias("text"))
    index = read.mapInArrow(_segments(vocabulary, segment_words), _INDEX)
    return checkpoint(index.withColumn("segment", F.monotonically_increasing_id()))


def term_counts(index: DataFrame) -> DataFrame:
    """term and n: occurrences in the whole corpus."""
    sizes = F.expr("transform(terms, (t, i) -> struct(t as term, offsets[i + 1] - offsets[i] as n))")
    return index.select(F.explode(sizes).alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("n"))


def _ordered(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """query_id and terms (n, offset, word), rarest first; queries with a word the corpus lacks go."""
    rows = queries.withColumn("query", F.xxhash64("query_id", "words"))
    each = rows.select("query_id", "words", "query", F.posexplode("words").alias("offset", "term"))
    known = each.join(counts, "term")
    back = known.groupBy("query", "query_id", "words").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
    return back.where(F.size("terms") == F.size("words")).select("query", "query_id", "terms")


class _Queries:
    """A block of queries: word numbers and offsets, rarest word first. Ids are numbered from 0 on; a
    null id has a number too."""

    def __init__(self, rows):
        names = list(dict.fromkeys(r.query_id for r in rows))
        number = {i: k for k, i in enumerate(names)}
        self.names = pa.array(names, pa.int64())
        self.ids = np.array([number[r.query_id] for r in rows], np.int64)
        self.size = np.array([len(r.terms) for r in rows], np.int64)
        self.words = sorted({t.term for r in rows for t in r.terms})
        number = {w: k for k, w in enumerate(self.words)}
        wide = int(self.size.max())
        self.word = np.full((len(rows), wide), -1, np.int64)
        self.offset = np.zeros((len(rows), wide), np.int64)
        for k, r in enumerate(rows):
            self.word[k, : len(r.terms)] = [number[t.term] for t in r.terms]
            self.offset[k, : len(r.terms)] = [t.offset for t in r.terms]


class _Segment:
    def __init__(self, row: dict):
        self.starts, self.n_words = (np.asarray(row[k].values) for k in ("starts", "n_words"))
        self.offsets, self.positions = (np.asarray(row[k].values).astype(np.int64) for k in ("offsets", "positions"))
        self.terms = {t: k for k, t in enumerate(row["terms"].as_py())}
        self.length = int(self.starts[-1] + self.n_words[-1] + 1)
        # Sorted by term, then place: one search finds a place in any term's list.
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.offsets)) * self.length + self.positions

    def numbers(self, q: _Queries) -> np.ndarray:
        own = np.array([self.terms.get(w, -1) for w in q.words] + [-1], np.int64)
        return own[q.word]

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term * self.length + place
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (place >= 0) & (place < self.length) & (self.keys[at] == key)

    def below(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many entries of all lists come before (term, place)."""
        return np.searchsorted(self.keys, term * self.length + np.minimum(place, self.length))

    def anchors(self, q: _Queries, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Query numbers and places of their rarest terms, in blocks."""
        ok = np.flatnonzero(((term >= 0) | (q.word < 0)).all(axis=1))
        n = np.diff(self.offsets)[term[ok, 0]]
        total = np.cumsum(n)
        for part in np.split(np.arange(len(ok)), np.flatnonzero(np.diff(total // CANDIDATES)) + 1):
            if len(part):
                count = n[part]
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield np.repeat(ok[part], count), self.positions[np.repeat(self.offsets[term[ok[part], 0]], count) + inside]

    def phrases(self, q: _Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, first place and place behind the last of every exact match."""
        term, out = self.numbers(q), []
        for query, place in self.anchors(q, term):
            start = place - q.offset[query, 0]
            for k in range(1, q.word.shape[1]):
                ok = (q.word[query, k] < 0) | self.holds(term[query, k], start + q.offset[query, k])
                query, start = query[ok], start[ok]
                if not len(query):
                    break
            out.append((query, start))
        if not out:
            return (np.empty(0, np.int64),) * 3
        query, start = (np.concatenate(x) for x in zip(*out))
        return query, start, start + q.size[query]

    def near(self, q: _Queries, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for matches in any order: from a first word on, all words of the query, as often
        as it has them, stand within its length plus ``slop`` places of one document."""
        term, out = self.numbers(q), []
        last = np.repeat(self.starts + self.n_words, self.n_words + 1)[: self.length]
        for query, place in self.anchors(q, term):
            width = q.size[query] + slop
            # Starts are the places of any query word at most ``width - 1`` before the rarest one.
            pairs = []
            for k in range(q.word.shape[1]):
                use = np.flatnonzero(q.word[query, k] >= 0)
                lo = self.below(term[query[use], k], np.maximum(place[use] - width[use] + 1, 0))
                hi = self.below(term[query[use], k], place[use] + 1)
                n = hi - lo
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append((np.repeat(query[use], n), self.positions[np.repeat(lo, n) + inside]))
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs)]), axis=1)
            query, start = both
            stop = np.minimum(start + q.size[query] + slop, last[start])
            end, ok = start + 1, np.ones(len(query), bool)
            for k in range(q.word.shape[1]):
                use = q.word[query, k] >= 0
                same = (q.word[query] == q.word[query, k][:, None]) & (np.arange(q.word.shape[1]) <= k)
                nth = self.below(np.where(use, term[query, k], 0), start) + same.sum(axis=1) - 1
                top = self.below(np.where(use, term[query, k], 0), stop)
                ok &= ~use | (nth < top)
                end = np.maximum(end, np.where(use & (nth < top), self.positions[np.minimum(nth, len(self.positions) - 1)] + 1, 0))
            out.append((query[ok], start[ok], end[ok]))
        if not out:
            return (np.empty(0, np.int64),) * 3
        found = np.unique(np.stack([np.concatenate(x) for x in zip(*out)]), axis=1)
        return found[0], found[1], found[2]


def _search(block, slop: int | None, whole_documents: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                seg = _Segment(row)
                query, start, end = seg.phrases(q) if slop is None else seg.near(q, slop)
                doc = np.searchsorted(seg.starts, start, side="right") - 1
                shared = [row["doc_ids"].values, row["keys"].values]
                if not whole_documents:
                    at = pa.array(doc)
                    shift = seg.starts[doc]
                    cols = [c.take(at) for c in shared] + [q.names.take(pa.array(q.ids[query])), pa.array(start - shift), pa.array(end - shift)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key_text", "query_id", "start", "end"])
                    continue
                step = np.zeros(seg.length + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, end, -1)
                hit = (np.cumsum(step)[:-1] > 0).astype(np.int8)
                edge = np.diff(np.r_[0, hit, 0])
                first, behind = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                owner = np.searchsorted(seg.starts, first, side="right") - 1
                pairs = np.unique(np.stack([doc, q.ids[query]]), axis=1)
                n = len(seg.starts)
                spans = pa.StructArray.from_arrays(
                    [pa.array(first - seg.starts[owner]).cast(pa.int32()), pa.array(behind - seg.starts[owner]).cast(pa.int32())], ["start", "end"]
                )
                cut = lambda of: pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
                cols = [
                    pa.array(np.full(n, row["segment"].as_py())), pa.array(np.arange(n, dtype=np.int32)), *shared, row["n_words"].values.cast(pa.int64()),
                    pa.ListArray.from_arrays(cut(owner), spans), pa.ListArray.from_arrays(cut(pairs[0]), q.names.take(pa.array(pairs[1]))),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["segment", "row", "doc_id", "key_text", "n_words", "spans", "items"])

    return run


_MATCH = "doc_id long, key_text long, query_id long, start long, end long"
_DOC = "segment long, row int, doc_id long, key_text long, n_words long, spans array<struct<start:int,end:int>>, items array<long>"


def _passes(index: DataFrame, queries: DataFrame, slop: int | None, whole: bool, block: int) -> list[DataFrame]:
    """One pass over the index per block of queries (query_id, words)."""
    spark = index.sparkSession
    ordered = checkpoint(_ordered(queries, term_counts(index)))
    blocks = -(-ordered.count() // block)
    out = []
    for k in range(blocks):
        rows = ordered.where(F.pmod("query", F.lit(blocks)) == k).select("query_id", "terms").collect()
        if rows:
            sent = spark.sparkContext.broadcast(_Queries(rows))
            out.append(index.mapInArrow(_search(sent, slop, whole), _DOC if whole else _MATCH))
    return out


def matches(docs: DataFrame, queries: DataFrame, slop: int | None = None, block: int = BLOCK, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Every match of ``queries`` (query_id, words) in ``docs``: doc_id, query_id, start, end (word
    numbers in the document, end excluded).

    Without ``slop`` exact phrases. With it proximity: one row for each place that holds a query word
    and from which all words of the query, in any order and as often as the query has them, stand
    within its length plus ``slop`` words; ``end`` is the least possible. A null query_id stays null.
    """
    index = build_index(docs, queries.select(F.explode("words").alias("term")), segment_words)
    found = _passes(index, queries.where(F.size("words") > 0), slop, False, block)
    if not found:
        return index.sparkSession.createDataFrame([], "doc_id long, query_id long, start long, end long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop("key_text")


def contamination(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, block: int = BLOCK, segment_words: int = SEGMENT_WORDS, with_text_key: bool = False
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Columns: doc_id, n_words, n_hit (words inside an occurrence of any window of ``size`` item words),
    n_items (items with such a window), items_sha256 (their ids as strings, sorted, comma-joined),
    contaminated (n_hit > 0). Null and empty texts have no words and no hits; items without words
    match nothing; repeated items count once per id, repeated rows each get a row; other columns are
    not read; without items every document is clean. Items of a null id match like others and count
    as one item, but the id is left out of items_sha256.
    """
    queries = checkpoint(windows(items, size)).withColumnRenamed("item_id", "query_id")
    index = build_index(docs, queries.select(F.explode("words").alias("term")), segment_words)
    keys = ["segment", "row", "doc_id", "key_text", "n_words"]
    passes = _passes(index, queries, None, True, block)
    if not passes:
        each = F.expr("transform(doc_ids, (d, i) -> struct(d as doc_id, keys[i] as key_text, n_words[i] as n_words))")
        rows = index.select(F.explode(each).alias("d")).select("d.*")
        rows = rows.select("doc_id", "key_text", F.col("n_words").cast("long"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), F.expr("cast(array() as array<long>)").alias("items"))
    elif len(passes) == 1:
        rows = passes[0]
    else:
        rows = passes[0]
        for more in passes[1:]:
            rows = rows.unionByName(more)
        # One row per document and pass: as many as there are blocks of queries.
        rows = rows.groupBy(*keys).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    covered = F.expr(
        "aggregate(array_sort(spans), named_struct('n', 0L, 'upto', 0), "
        "(a, s) -> named_struct('n', a.n + greatest(0, s.end - greatest(s.start, a.upto)), 'upto', greatest(a.upto, s.end)), a -> a.n)"
    )
    names = F.array_sort(F.array_distinct(F.transform("items", lambda i: i.cast("string"))))
    out = rows.select(*["doc_id", "n_words"], covered.alias("n_hit"), names.alias("names"), "key_text")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        *(["key_text"] if with_text_key else []),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they were."""
    found = contamination(docs, items, size, with_text_key=True)
    return drop_rows(docs, found.where("contaminated").select(F.col("doc_id").alias("key_id"), "key_text"))
