"""SimHash near-duplicates: 64-bit fingerprints, linked at a few differing bits, as components.

The distinct fingerprints are put in four Gray orders, one for each rotation by 16 bits, and each order is cut
into sub-trees of about ``SUBTREE_ROWS`` codes by the first bits of the Gray rank, as many as that takes. Codes
that differ in at most three of 64 bits agree on one of four blocks of 16, so in the order that begins with this
block they are in one sub-tree. A task searches a sub-tree by the Gray-order hierarchical index
(``gray_index``): bits that neighbours share are compared once for all of them, and whole groups of pairs fall
by accumulated differences. A sub-tree that came out much too large is dealt out once more by blocks of its
remaining bits, which loses no link and ends because codes are distinct. Sub-trees pass on one edge per
linked fingerprint, never all pairs; the edges are contracted into components by star operations on narrow
rows. Texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import checkpoint, drop_rows, salt_of, salt_set, salts_in, text_key
from parchment.llm.gray_index import GrayIndex

BITS = 3
SEED = 42
# Codes of a sub-tree; one with four times as many is split once more.
SUBTREE_ROWS = 20_000
TASK_ROWS = 100_000
_PLANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < 3:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-3]].tolist()
    stops = (ends[2:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint_texts(texts: list[bytes | None], block: int = 200_000) -> np.ndarray:
    """Fingerprints of UTF-8 texts: the bits set in more than half of a text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def flush() -> None:
        size = np.array([len(h) for h in held])
        doc = np.repeat(np.arange(len(held)), size) * 256
        octets = np.concatenate(held).view(np.uint8).reshape(-1, 8)
        code = np.zeros(len(held), np.uint64)
        for k in range(8):
            seen = np.bincount(doc + octets[:, k], minlength=256 * len(held)).reshape(-1, 256)
            set_ = (seen @ _PLANES) * 2 > size[:, None]
            code |= (set_ << np.arange(8)).sum(axis=1).astype(np.uint64) << np.uint64(8 * k)
        out[rows] = code

    n = 0
    for row, text in enumerate(texts):
        h = _hashes(text)
        if not len(h):
            continue
        held.append(h)
        rows.append(row)
        n += len(h)
        if n >= block or len(held) >= 2_000:
            flush()
            held, rows, n = [], [], 0
    if held:
        flush()
    return out


@F.pandas_udf(T.LongType())
def _fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(fingerprint_texts(texts.tolist()).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and code (the fingerprint as a signed long) of every row; words are cut at ASCII white
    space after lower-casing A-Z, shingles have three words (fewer: the whole sequence; no word or a
    null text: zero)."""
    return docs.select("doc_id", _fingerprint(F.col("text").cast("binary")).alias("code"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _orders(n: int, bits: int, subtree_rows: int) -> list[int]:
    """Masks of the first bits of each Gray order, by which ``n`` codes fall into sub-trees. The first bits of the
    Gray rank follow from the same bits of the code and the reverse, so they name the same sub-trees."""
    blocks = _masks(0, bits)
    width = min(max(n // subtree_rows, 0).bit_length(), min(b.bit_count() for b in blocks))
    if not width:
        return [0]
    return [((1 << width) - 1) << b.bit_length() - width for b in blocks]


def _masks(mask: int, bits: int) -> list[int]:
    """``mask`` joined with each of ``bits + 1`` blocks of the bits it leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (bits + 1) for k in range(bits + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in pairwise(cuts)]


def _route(codes: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Rows (mask, value, code): one per mask that follows from the row's present one."""
    table = F.create_map(*[F.lit(x) for m, to in masks.items() for x in (_signed(m), F.array(*[F.lit(_signed(t)) for t in to]))])
    out = codes.select(F.explode(table[F.col("mask")]).alias("mask"), "code")
    return out.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code")


def _link_buckets(bits: int, task_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(mask, value, code):
            change = np.r_[False, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
            # Turned so that the order begins with the bits the sub-tree shares.
            turn = np.array([64 - int(m).bit_length() & 63 for m in mask.view(np.uint64)], np.uint64)
            back = np.uint64(64) - turn & np.uint64(63)
            codes = code.view(np.uint64)
            turned = codes << turn | codes >> back
            roots = GrayIndex(np.where(turn == 0, codes, turned), np.cumsum(change)).link(bits)
            roots = np.where(turn == 0, roots, roots >> turn | roots << back)
            other = roots != codes
            return pa.RecordBatch.from_arrays([pa.array(code[other]), pa.array(roots[other].view(np.int64))], ["u", "v"])

        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
            n += batch.num_rows
            if n >= task_rows:
                rows = np.concatenate(held, axis=1)
                last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
                cut = int(np.argmax(last))
                if cut:
                    yield edges(*rows[:, :cut])
                held, n = [rows[:, cut:]], rows.shape[1] - cut
        if n:
            yield edges(*np.concatenate(held, axis=1))

    return run


def links(codes: DataFrame, bits: int = BITS, subtree_rows: int = SUBTREE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Edges (u, v) between distinct codes (column ``code``) that join the same components as all
    pairs of at most ``bits`` differing bits do."""
    level = codes.select(F.lit(0).cast("long").alias("mask"), "code")
    masks = {0: _orders(codes.count(), bits, subtree_rows)}
    out = None
    while True:
        keyed = _route(level, masks)
        sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * subtree_rows)
        free = 64 - min(bin(m).count("1") for to in masks.values() for m in to)
        hot = None
        if 1 << free > 4 * subtree_rows:
            hot = checkpoint(sizes.select("mask", "value"))
            if hot.isEmpty():
                hot = None
        calm = keyed if hot is None else keyed.join(hot, ["mask", "value"], "left_anti")
        # Sorted, so that a task reads one sub-tree after another.
        found = (
            calm.select("mask", "value", "code")
            .repartition("mask", "value")
            .sortWithinPartitions("mask", "value")
            .mapInArrow(_link_buckets(bits, task_rows), "u long, v long")
        )
        out = found if out is None else out.unionByName(found)
        if hot is None:
            return out
        level = checkpoint(keyed.join(hot, ["mask", "value"], "left_semi").select("mask", "code"))
        masks = {m: _masks(m, bits) for to in masks.values() for m in to}


def components(edges: DataFrame) -> DataFrame:
    """Node and root (the smallest node of its component) for every node of ``edges`` (u, v).

    Alternates two star operations until every node points at its root. Both use a minimum per node,
    which combines before the shuffle; no neighbour list is gathered.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = checkpoint(edges.where("u <> v").select(big.alias("u"), small.alias("v")).distinct())
    while True:
        parent = now.groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("n"))
        has_parent = now.join(parent.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        if parent.where("n > 1").isEmpty() and has_parent.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # Smaller neighbours of a node are tied to the smallest of them ...
        near = now.join(parent, "u").select(F.when(F.col("v") == F.col("p"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("p").alias("v"))
        near = checkpoint(near.distinct())
        # ... and larger ones to the node's own smallest.
        up = near.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("p"))
        far = near.join(up, "v", "left").select("u", F.coalesce("p", "v").alias("v"))
        now = checkpoint(far.where("u <> v").distinct())


def near_duplicates(
    docs: DataFrame, bits: int = BITS, subtree_rows: int = SUBTREE_ROWS, with_text_key: bool = False
) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): its fingerprint and component.

    Columns: doc_id, fingerprint (16 hex digits), component_id. Documents are linked when their
    fingerprints differ in at most ``bits`` bits; component_id is the smallest doc_id reachable. Null
    and empty texts have fingerprint zero and are linked like others. Null ids are passed over in the
    minimum; a component of null ids only has a null component_id. Repeated rows each get a row.
    Other columns are not read; an empty table gives an empty result. With ``with_text_key`` also
    key_text and root, the least code of the component, which tells components apart that share a label.
    """
    extra = [text_key(F.coalesce(F.col("text"), F.lit(""))).alias("key_text")] if with_text_key else []
    read = docs.select("doc_id", _fingerprint(F.col("text").cast("binary")).alias("code"), *extra)
    rows = checkpoint(read.withColumn("salt", salt_of(F.col("doc_id"))))
    salted = rows.groupBy("code", "salt").agg(F.min("doc_id").alias("least"))
    distinct = checkpoint(salted.groupBy("code").agg(F.min("least").alias("least"), salt_set("salt").alias("salts")))
    roots = components(links(distinct.select("code"), bits, subtree_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("code", salts_in("salts").alias("salt"), "component_id", "root")
    out = rows.join(classes, ["code", "salt"])
    fingerprint = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return out.select("doc_id", fingerprint.alias("fingerprint"), "component_id", *(["key_text", "root"] if with_text_key else []))


def one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, all columns as they were.

    Rows of one component that repeat that doc_id may differ in text; one text of them stays. Components
    that share a label, as those of null ids only do, each keep one text.
    """
    rows = near_duplicates(docs, bits, with_text_key=True).groupBy(F.col("doc_id").alias("key_id"), "key_text", "component_id", "root")
    found = checkpoint(rows.agg(F.count(F.lit(1)).alias("n")))
    labelled = found.where(F.col("key_id").eqNullSafe(F.col("component_id")))
    first = labelled.groupBy("root", F.col("key_id").alias("own")).agg(F.min("key_text").alias("stays"))
    # Joined by id and text too, so that a large component is spread.
    same = (found["root"] == first["root"]) & found["key_id"].eqNullSafe(first["own"]) & (found["key_text"] == first["stays"])
    judged = found.join(first, same, "left").select("key_id", "key_text", "n", F.col("stays").isNotNull().alias("stay"))
    return drop_rows(docs, judged.where("not stay"), judged.where("stay and n > 1"))
