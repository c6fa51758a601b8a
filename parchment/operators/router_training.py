"""Multinomial logistic regression whose weights are never in one place.

Started at zero, every iterate and gradient of the weights is a combination of the texts' feature rows, so a
vector of weights is kept as one coefficient per text and class (its ``dual``) beside the products of the feature
rows with it (its ``margin``). Their dot products are sums over texts; L-BFGS and its line search need nothing
else. The driver holds intercepts and the dot products of the history.

Texts are numbered and their vectors kept in rows of ``CHUNK`` texts. The entries of texts and terms lie in blocks
of whole terms, so that a product with the feature rows and back is one pass over them: each task is sent the
duals and passes on its share of the margins. Beyond ``SENT_DUALS`` numbers the product is two joins instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.session import stored, work_dir

# Pairs of steps and changes of gradient that are kept.
PAIRS = 4
TOLERANCE = 1e-6
FIRST_STEPS = [4.0**k for k in range(-2, 13)]
STEPS = [2.0**k for k in range(-6, 4)]
CHUNK = 4096
# Duals (texts times classes) that may be sent to every task, at eight bytes each.
SENT_DUALS = 8_000_000
# Entries of a block; a term is never cut, and has at most an entry per text.
BLOCK_ENTRIES = 500_000

_STATE = "chunk long, label binary, own binary, v binary"


def _array(batch: pa.RecordBatch, column: str, row: int, kind=np.float64) -> np.ndarray:
    value = batch.column(column)[row]
    return np.frombuffer(value.as_buffer() if value.is_valid else b"", dtype=kind)


def _vectors(batch: pa.RecordBatch, column: str, row: int, texts: int, classes: int) -> np.ndarray:
    """(vectors, texts, classes)"""
    return _array(batch, column, row).reshape(-1, texts, classes)


def _residuals(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each text; probabilities less the labels."""
    top = margin.max(axis=1, keepdims=True)
    e = np.exp(margin - top)
    total = e.sum(axis=1, keepdims=True)
    at = np.arange(len(label))
    loss = np.log(total[:, 0]) + top[:, 0] - margin[at, label]
    p = e / total
    p[at, label] -= 1.0
    return loss, p


def _summed(state: DataFrame, size: int, classes: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part``, ``size`` numbers a chunk's vectors and labels: a task passes on one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in range(batch.num_rows):
                label = _array(batch, "label", row, np.int32)
                total += part(_vectors(batch, "v", row, len(label), classes), label)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["x"])

    sums = state.mapInArrow(run, "x array<double>").select(F.posexplode("x")).groupBy("pos").agg(F.sum("col"))
    out = np.zeros(size)
    for pos, value in sums.collect():
        out[pos] = value
    return out


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows``, stored with ``t`` from 0 on, and how many there are."""
    marked = stored(rows.withColumn("_mark", F.monotonically_increasing_id()), "numbered-texts")
    task = F.shiftrightunsigned("_mark", 33)
    sizes = marked.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    starts = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
    offsets = marked.sparkSession.createDataFrame(
        [(r["task"], s - (r["task"] << 33)) for r, s in zip(sizes, starts, strict=False)], "task long, offset long"
    )
    numbered = marked.withColumn("task", task).join(F.broadcast(offsets), "task")
    return numbered.withColumn("t", F.col("_mark") + F.col("offset")).drop("_mark", "task", "offset"), starts[-1]


def _chunks(texts: DataFrame, classes: int) -> DataFrame:
    """Rows of ``CHUNK`` texts from (t, label, own), with weights of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
            chunk = table["t"].to_numpy() // CHUNK
            label, own = table["label"].to_numpy().astype(np.int32), table["own"].to_numpy()
            begin = np.flatnonzero(np.diff(chunk, prepend=-1))
            for a, b in zip(begin, [*begin[1:], len(chunk)], strict=True):
                parts = [label[a:b].tobytes(), own[a:b].tobytes(), np.zeros((2, b - a, classes)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([chunk[a]]), *[pa.array([x], pa.binary()) for x in parts]], ["chunk", "label", "own", "v"])

        for batch in batches:
            waiting.append(batch)
            last = batch.column("t")[-1].as_py() // CHUNK if batch.num_rows else -1
            table = pa.Table.from_batches(waiting)
            done = int(np.searchsorted(table["t"].to_numpy(), last * CHUNK)) if last >= 0 else 0
            if done:
                yield from rows(table.slice(0, done))
                waiting = table.slice(done).to_batches()
        if waiting:
            yield from rows(pa.Table.from_batches(waiting))

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(parts, F.floor(F.col("t") / CHUNK)).sortWithinPartitions("t")
    return dealt.select("t", "label", "own").mapInArrow(run, _STATE)


def _blocks(linked: DataFrame) -> DataFrame:
    """Rows of whole terms from (t, i, weight): texts, weights, and where each term ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0

        def row(table: pa.Table) -> pa.RecordBatch:
            i = table["i"].to_numpy()
            ends = np.append(np.flatnonzero(i[1:] != i[:-1]) + 1, len(i)).astype(np.int32)
            parts = [table["t"].to_numpy().astype(np.int32), table["weight"].to_numpy(), ends]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["t", "weight", "ends"])

        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= BLOCK_ENTRIES:
                table = pa.Table.from_batches(waiting)
                whole = int(np.searchsorted(table["i"].to_numpy(), table["i"][-1].as_py()))
                if whole:
                    yield row(table.slice(0, whole))
                    waiting, held = table.slice(whole).combine_chunks().to_batches(), held - whole
        if held:
            yield row(pa.Table.from_batches(waiting))

    parts = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return linked.repartition(parts, "i").sortWithinPartitions("i").mapInArrow(run, "t binary, weight binary, ends binary")


def _margins(blocks: DataFrame, dual: np.ndarray) -> DataFrame:
    """(chunk, margin) of the duals: over the terms that texts share, there and back, in one pass over the entries."""
    n, classes = dual.shape
    sent = blocks.sparkSession.sparkContext.broadcast(dual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dual, total = sent.value, np.zeros((n, classes))
        for batch in batches:
            for at in range(batch.num_rows):
                t, weight, ends = _array(batch, "t", at, np.int32), _array(batch, "weight", at), _array(batch, "ends", at, np.int32)
                size = np.diff(ends, prepend=0)
                for c in range(classes):
                    of_term = np.add.reduceat(weight * dual[t, c], ends - size)
                    total[:, c] += np.bincount(t, weights=weight * np.repeat(of_term, size), minlength=n)
        for chunk, begin in enumerate(range(0, n, CHUNK)):
            part = total[begin : begin + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part.tobytes()], pa.binary())], ["chunk", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["chunk", "margin"])
        for batch in batches:
            for at, chunk in enumerate(batch.column("chunk").to_pylist()):
                part = _array(batch, "part", at)
                if chunk == now:
                    total += part
                    continue
                if now is not None:
                    yield row()
                now, total = chunk, part.copy()
        if now is not None:
            yield row()

    # A task's share is as long as there are texts, so there are no more tasks than cores.
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    shares = blocks.coalesce(tasks).mapInArrow(run, "chunk long, part binary")
    return shares.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk long, margin binary")


def product(linked: DataFrame, vector: DataFrame, classes: int) -> DataFrame:
    """(t, margin) of (t, dual): over the terms that texts share, there and back, by two joins."""
    by_term = (
        linked.join(vector, "t").groupBy("i").agg(*[F.sum(F.col("weight") * F.get("dual", F.lit(c))).alias(f"u{c}") for c in range(classes)])
    )
    sums = linked.join(by_term, "i").groupBy("t").agg(*[F.sum(F.col("weight") * F.col(f"u{c}")).alias(f"u{c}") for c in range(classes)])
    return sums.select("t", F.array(*[F.col(f"u{c}") for c in range(classes)]).alias("margin"))


def _by_text(chunks: DataFrame, column: str, classes: int) -> DataFrame:
    """(t, an array of a number per class) of (chunk, ``column``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in enumerate(batch.column("chunk").to_pylist()):
                flat = _array(batch, column, at)
                ends = np.arange(0, len(flat) + 1, classes, dtype=np.int32)
                t = chunk * CHUNK + np.arange(len(ends) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["t", column])

    return chunks.mapInArrow(run, f"t long, {column} array<double>")


def _joined_margins(linked: DataFrame, duals: DataFrame, n: int, classes: int) -> DataFrame:
    """``_margins`` by joins, whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["chunk", "margin"])
        for batch in batches:
            t = batch.column("t").to_numpy()
            values = batch.column("margin").flatten().to_numpy().reshape(len(t), classes)
            chunk = t // CHUNK
            for c in np.unique(chunk).tolist():
                if c != now:
                    if now is not None:
                        yield row()
                    now, total = c, np.zeros((min(CHUNK, n - c * CHUNK), classes))
                total[t[chunk == c] - c * CHUNK] = values[chunk == c]
        if now is not None:
            yield row()

    parts = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = product(linked, _by_text(duals, "dual", classes), classes)
    return found.repartition(parts, F.floor(F.col("t") / CHUNK)).sortWithinPartitions("t").mapInArrow(run, "chunk long, margin binary")


def _direction(dots: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the basis (weights, gradient, then step and change of each pair, oldest first)."""
    d = np.zeros(len(dots))
    d[1] = -1.0
    alpha = {}
    at = [(2 + 2 * p, 3 + 2 * p) for p in range(pairs)]
    for s, y in reversed(at):
        alpha[s] = dots[s] @ d / dots[s, y]
        d[y] -= alpha[s]
    if at:
        s, y = at[-1]
        d *= dots[s, y] / dots[y, y]
    for s, y in at:
        d[s] += alpha[s] - dots[y] @ d / dots[s, y]
    return d


def fit(
    entries: DataFrame, labels: DataFrame, key: str, classes: int, penalty: float, iterations: int, sent_duals: int = SENT_DUALS
) -> tuple[DataFrame, list[float]]:
    """(key, dual) and the intercepts; the weights of a term are the sum of weight * dual over its texts.

    ``entries``: (key, i, weight, shared), a row per text and term; ``shared`` is false for a term of one text.
    Such terms only give a text's product with itself, so they stay out of the products. ``labels``: (key, label)
    with labels from 0; a key that comes twice is two texts with the same terms. The mean loss plus ``penalty`` / 2
    times the squared weights is made least.
    """
    spark = entries.sparkSession
    copies = F.count("*").over(Window.partitionBy(key)) > 1
    # Texts without any term are left out.
    with_terms = labels.join(entries.select(key).distinct(), key)
    texts, n = _numbered(with_terms.select(key, F.col("label").cast("int").alias("label"), copies.alias("again")))
    of_class = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if None in of_class:
        raise ValueError("labels must not be null")
    prior = np.log([float(max(of_class.get(c, 0), 1)) for c in range(classes)])
    placed = entries.join(texts.select(key, "t", "again"), key)
    in_joins = F.col("shared") | F.col("again")
    linked = placed.where(in_joins).select("t", "i", "weight")
    own = placed.where(~in_joins).groupBy("t").agg(F.sum(F.col("weight") * F.col("weight")).alias("own"))
    known = texts.select("t", "label").join(own, "t", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    send = n * classes <= sent_duals
    linked = stored(_blocks(linked) if send else linked, "linked-terms")
    base = work_dir(spark, "training-state")

    def kept(rows: DataFrame, turn: int) -> DataFrame:
        # Two folders in turn: the state before is read while the next one is written.
        folder = f"{base}/{turn % 2}"
        rows.write.mode("overwrite").parquet(folder)
        return spark.read.schema(_STATE).parquet(folder)

    def moved(v: np.ndarray, step: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Weights after the step, and the step itself."""
        if step is None:
            return v[:2], None
        s = np.stack([np.tensordot(step, v[side::2], 1) for side in (0, 1)])
        return v[:2] + s, s

    def gradient(weights: np.ndarray, label: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        return _residuals(weights[1] + intercept, label)[1] / n + penalty * weights[0]

    def gradients(step: np.ndarray | None, intercept: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    label = _array(b, "label", row, np.int32)
                    dual = gradient(moved(_vectors(b, "v", row, len(label), classes), step)[0], label, intercept)
                    yield pa.RecordBatch.from_arrays([b.column("chunk").slice(row, 1), pa.array([dual.tobytes()], pa.binary())], ["chunk", "dual"])

        return run

    def settled(step: np.ndarray | None, intercept: np.ndarray, drop: bool):
        """After the step: the new gradient takes its place, step and change of the gradient are the newest pair."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    label, own = _array(b, "label", row, np.int32), _array(b, "own", row)
                    v = _vectors(b, "v", row, len(label), classes)
                    weights, s = moved(v, step)
                    dual = gradient(weights, label, intercept)
                    margin = own[:, None] * dual
                    if b.column("margin")[row].is_valid:
                        margin += _vectors(b, "margin", row, len(label), classes)[0]
                    g = np.stack([dual, margin])
                    pair = [] if s is None else [s, g - v[2:4]]
                    new = np.concatenate([weights, g, v[8:] if drop else v[4:], *pair])
                    yield pa.RecordBatch.from_arrays([*[b.column(k).slice(row, 1) for k in ("chunk", "label", "own")], pa.array([new.tobytes()], pa.binary())], ["chunk", "label", "own", "v"])

        return run

    def margins(duals: DataFrame) -> DataFrame:
        if not send:
            return _joined_margins(linked, duals, n, classes)
        dual = np.zeros((n, classes))
        for chunk, part in duals.collect():
            dual[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(part).reshape(-1, classes)
        return F.broadcast(_margins(linked, dual))

    def dot_products(v: np.ndarray, label: np.ndarray) -> np.ndarray:
        vectors = v.reshape(len(v), -1)
        return (vectors[0::2] @ vectors[1::2].T).ravel()

    def tried(step: np.ndarray, by: list[float], intercept: np.ndarray, turn: np.ndarray):
        """For each length: the loss, and the classes' residuals, which are the gradient of the intercepts."""

        def part(v: np.ndarray, label: np.ndarray) -> np.ndarray:
            d = np.tensordot(step, v[1::2], 1)
            out = []
            for t in by:
                loss, p = _residuals(v[1] + t * d + intercept + t * turn, label)
                out += [loss.sum(), *p.sum(axis=0)]
            return np.array(out)

        return part

    state = kept(_chunks(known, classes), 1)
    basis = np.zeros((2, classes))  # the intercepts' part of weights and gradient, then of each pair
    basis[0] = prior - prior.mean()
    start = _summed(state, 1 + classes, classes, tried(np.zeros(1), [0.0], basis[0], np.zeros(classes)))
    value, slope = start[0] / n, start[1:] / n
    step = None
    for turn in range(iterations):
        first, drop = turn == 0, turn > PAIRS
        back = margins(state.mapInArrow(gradients(step, basis[0]), "chunk long, dual binary"))
        state = kept(state.join(back, "chunk", "left").mapInArrow(settled(step, basis[0], drop), _STATE), turn)
        if first:
            basis = np.stack([basis[0], slope])
        else:
            basis = np.concatenate([basis[:1], slope[None], basis[4:] if drop else basis[2:], (slope - basis[1])[None]])
        size = len(basis)
        weights = _summed(state, size**2, classes, dot_products).reshape(size, -1)
        weights = (weights + weights.T) / 2
        step = _direction(weights + basis @ basis.T, (size - 2) // 2)
        by = FIRST_STEPS if first else STEPS
        found = _summed(state, len(by) * (1 + classes), classes, tried(step, by, basis[0], step @ basis)).reshape(len(by), -1) / n
        squares = np.array([(u := np.eye(size)[0] + t * step) @ weights @ u for t in by])
        values = found[:, 0] + penalty / 2 * squares
        best = int(np.nanargmin(values))
        if not values[best] < value:
            step = None
            break
        gain, value, slope = value - values[best], values[best], found[best, 1:]
        step = by[best] * step
        turned = (step @ basis)[None]
        basis = np.concatenate([basis[:1] + turned, basis[1:], turned])
        if gain <= TOLERANCE * max(abs(value), 1e-12):
            break

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                texts_here = len(_array(b, "label", row, np.int32))
                dual = moved(_vectors(b, "v", row, texts_here, classes), step)[0][0]
                yield pa.RecordBatch.from_arrays([b.column("chunk").slice(row, 1), pa.array([dual.tobytes()], pa.binary())], ["chunk", "dual"])

    dual = _by_text(state.mapInArrow(weighed, "chunk long, dual binary"), "dual", classes)
    return texts.select(key, "t").join(dual, "t").select(key, "dual"), [float(b) for b in basis[0]]
