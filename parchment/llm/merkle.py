"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a source form a tree, the sources' roots another one. A node is
labelled by the last leaf below it and its level, so children have smaller labels than their parents.

Upwards, a task meets its nodes in label order and a priority queue holds digests on their way: a node
takes its children's digests from the queue's front and puts its own in for its parent. Downwards the
labels run backwards and the queue holds proof suffixes on their way from parents to children.

The queue is external: one task works off ``HEIGHT`` levels over one aligned run of ``3 ** HEIGHT`` nodes,
and what goes on to later labels than that is a message in the shared folder, which the next shuffle
delivers sorted by label. So a source with most of all rows is as many runs as it needs, a task holds
one run, and the rounds grow with the logarithm of the largest source. Texts are read once, in the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import checkpoint
from parchment.session import broadcast_if_small

FAN = 3
HEIGHT = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree string, n long, pos long, digest string"
Link = tuple[str, str, "Link"] | None


def _digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _levels(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _label(level: int, index: int, n: int) -> int:
    """Last of the ``n`` nodes of level 0 below a node."""
    return min((index + 1) * FAN**level, n) - 1


def sweep_up(nodes: list[tuple[int, str]], n: int, top: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Digest of the node ``top`` levels above one run of (position, digest), and the children of every
    node on the way. ``n`` is the number of all nodes of this level in the tree."""
    queue: list[tuple[int, int, int, str]] = []
    children: dict[tuple[int, int], list[str]] = {}
    digest = nodes[0][1]
    if not top:
        return digest, children
    for pos, own in nodes:
        heappush(queue, (_label(1, pos // FAN, n), 1, pos, own))
        while queue and queue[0][0] == pos:
            end, level, index, first = heappop(queue)
            held = [first]
            while queue and queue[0][:2] == (end, level):
                held.append(heappop(queue)[3])
            node = index // FAN
            children[level, node] = held
            digest = _digest(held)
            if level < top:
                heappush(queue, (_label(level + 1, node // FAN, n), level + 1, node, digest))
    return digest, children


def sweep_down(children: dict, n: int, top: int, index: int, path: Link) -> Iterator[tuple[int, Link]]:
    """(position, path) of every node of level 0 below node ``index`` of level ``top``: the siblings to the
    left and right, level by level upwards, ending in the ``path`` of that node."""
    queue: list[tuple[int, int, int, Link]] = [(-_label(top, index, n), -top, index, path)]
    while queue:
        _, level, node, path = heappop(queue)
        if not level:
            yield node, path
            continue
        held = children[-level, node]
        for k in range(len(held)):
            child = node * FAN + k
            link = ("".join(held[:k]), "".join(held[k + 1 :]), path)
            heappush(queue, (-_label(-level - 1, child, n), level + 1, child, link))


def steps(path: Link) -> Iterator[tuple[str, str]]:
    while path:
        left, right, path = path
        yield left, right


def _written(path: Link) -> str:
    return ";".join(f"{left},{right}" for left, right in steps(path))


def _read(path: str) -> Link:
    out: Link = None
    for step in reversed(path.split(";") if path else []):
        left, right = step.split(",")
        out = (left, right, out)
    return out


def proof(path: Link) -> str:
    return _digest(side for step in steps(path) for side in step)


def fold(leaf: str, path: Link) -> str:
    """The root that follows from a leaf and its path."""
    for left, right in steps(path):
        leaf = _digest((left, leaf, right))
    return leaf


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, run in groupby(rows, key=lambda r: (r["tree"], r["chunk"])):
        yield list(run)


def _blocks(rows: Iterator[dict], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _by_run(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "pos")


def _chunk(height: int) -> Column:
    return F.expr(f"pos div {FAN**height}")


def _climb_run(height: int):
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())])

    def up(run: list[dict]) -> dict:
        first = run[0]
        digest, _ = sweep_up([(r["pos"], r["digest"]) for r in run], first["n"], min(height, _levels(first["n"])))
        return {"tree": first["tree"], "n": -(-first["n"] // FAN**height), "pos": first["chunk"], "digest": digest}

    return lambda batches: _blocks(map(up, _runs(batches)), schema)


def climb(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The rounds of the upward sweep over nodes (tree, n, pos, digest): each holds what one round left of
    the one before, the last one a root per tree."""
    rounds = [nodes]
    while True:
        rows = rounds[-1].select("tree", "n", "pos", "digest", _chunk(height).alias("chunk"))
        rounds.append(checkpoint(_by_run(rows).mapInArrow(_climb_run(height), _NODES)))
        if rounds[-1].where("n > 1").isEmpty():
            return rounds


def _descend(nodes: DataFrame, messages: DataFrame, height: int, each: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``each(node, path, message)`` of every node, after one round of the downward sweep. Messages (tree, pos,
    path and what else the leaves are to get) come to the run whose top they are for."""

    def down(run: list[dict]) -> Iterator[dict]:
        message, nodes = run[0], run[1:]
        n = nodes[0]["n"]
        top = min(height, _levels(n))
        _, children = sweep_up([(r["pos"], r["digest"]) for r in nodes], n, top)
        paths = dict(sweep_down(children, n, top, message["chunk"], _read(message["path"])))
        for r in nodes:
            yield each(r, paths[r["pos"]], message)

    arriving = messages.withColumnRenamed("pos", "chunk").withColumn("pos", F.lit(-1).cast("long"))
    rows = nodes.withColumn("chunk", _chunk(height)).unionByName(arriving, allowMissingColumns=True)
    return _by_run(rows).mapInArrow(lambda batches: _blocks((x for run in _runs(batches) for x in down(run)), schema), ddl)


_MESSAGE = "tree string, pos long, path string, subroot string, root string"
_PATHS = pa.schema([(c, pa.int64() if c == "pos" else pa.string()) for c in ("tree", "pos", "path", "subroot", "root")])


def _to_run(r: dict, path: Link, m: dict) -> dict:
    return {"tree": r["tree"], "pos": r["pos"], "path": _written(path), "subroot": m["subroot"], "root": m["root"]}


def _to_source(r: dict, path: Link, m: dict) -> dict:
    return {"tree": r["name"], "pos": 0, "path": _written(path), "subroot": r["digest"], "root": m["root"]}


def descend(rounds: list[DataFrame], messages: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Messages (tree, pos, path, subroot, root) for the runs of the lowest round, from those for the roots."""
    for nodes in reversed(rounds[1:-1]):
        messages = checkpoint(_descend(nodes, messages, height, _to_run, _PATHS, _MESSAGE))
    return messages


def _field(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _leaf(text: Column) -> Column:
    fields = [_field(F.col(c).cast("string")) for c in FIELDS[:-1]]
    return F.sha2(F.concat(*fields, _field(text)).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 2 == 0


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and changed (the digest after tampering) of every row."""
    cut = tampered(F.col("doc_id")) & F.contains("text", F.lit("\n"))
    changed = F.when(cut, _leaf(F.translate("text", "\n", "")))
    rows = docs.select("doc_id", "source", _leaf(F.col("text")).alias("digest"), changed.alias("changed"))
    # A null source comes before all others, an empty one included.
    tree = F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit("n"))
    return rows.select(tree.alias("tree"), F.col("doc_id"), "digest", F.coalesce("changed", "digest").alias("changed"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos (from 0 along ``order`` in each ``tree``) and n (rows of the tree).

    One range exchange puts them in order, wherever the rows of a tree lie; places then follow from one
    count per range and tree.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    marked = checkpoint(ordered.withColumn("at", F.monotonically_increasing_id()))
    span, offset = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    marked = marked.withColumn("span", span).withColumn("at", offset)
    counted = marked.groupBy("span", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("tree")
    before = F.sum("size").over(whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("size").over(whole))
    starts = checkpoint(starts.drop("size"))
    out = marked.join(broadcast_if_small(starts), ["span", "tree"])
    return out.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("span", "at", "first", "before")


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, source, lang, n_chars, text): its leaf, and whether the
    tampered leaf still leads to the root.

    Columns: doc_id, leaf, subroot (of its source), root, proof_sha256 (of the siblings' digests, upwards),
    folded_root (from the leaf after tampering and the untampered siblings), verified. A null field is
    ``-`` in the leaf, an empty one ``0:``. Null ids come first in their source; rows that repeat an id are
    ordered by leaf; rows equal in all five fields have equal leaves and a place each. A null id is tampered
    with like the empty text. Other columns are not read. An empty table gives an empty result.
    """
    # Written first, since the ranges of the exchange are sampled from the same rows.
    found = placed(checkpoint(leaves(docs)), ["doc_id", "digest"])
    rounds = climb(checkpoint(found), height)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = placed(subroots, ["name"])
    upper = climb(checkpoint(sources), height)
    # The root is one row, or none over an empty table.
    start = upper[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    arrived = descend(upper, start, height)
    at_sources = _descend(upper[0], arrived, height, _to_source, _PATHS, _MESSAGE)
    messages = descend(rounds, checkpoint(at_sources), height)
    kind = dict(docs.dtypes)["doc_id"]
    out = pa.schema(
        [("doc_id", pa.string())]
        + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        + [("verified", pa.bool_())]
    )

    def at_leaf(r: dict, path: Link, m: dict) -> dict:
        folded = fold(r["changed"], path)
        return {
            "doc_id": r["doc_id"], "leaf": r["digest"], "subroot": m["subroot"], "root": m["root"],
            "proof_sha256": proof(path), "folded_root": folded, "verified": folded == m["root"],
        }

    nodes = rounds[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = _descend(
        nodes, messages, height, at_leaf, out,
        "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))
