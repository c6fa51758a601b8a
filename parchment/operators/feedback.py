"""Ratings of answers: current state, totals, approved examples, evaluation candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from parchment import dims
from parchment.functions.citations import strip_citations
from parchment.functions.text import token_estimate, tokens, trimmed
from parchment.session import stored

MAX_CORRECTION = 1000
EXAMPLES = 2
MIN_SIMILARITY = 0.2
EXAMPLE_TOKENS = 220


def records(events: DataFrame) -> DataFrame:
    """Rating events as records: reasons (known codes) and correction only for thumbs-down."""
    down = F.col("rating") == "down"
    known = F.array(*[F.lit(r) for r in dims.REASONS])
    return events.withColumn(
        "reasons",
        F.when(down, F.filter("reasons", lambda r: F.array_contains(known, r))).otherwise(F.array().cast("array<string>")),
    ).withColumn(
        "correction",
        F.when(down, F.substring(trimmed(F.coalesce("correction", F.lit(""))), 1, MAX_CORRECTION)).otherwise(""),
    )


def current_state(events: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Ratings in force: 👍 on a 👍 takes it back, anything else replaces.

    After the last 👎 only the number of later 👍 matters: odd leaves 👍, even leaves nothing, none
    leaves the 👎. Two aggregates and one join replace a walk over each key's events, so a key with
    most of the events is added up in parts. Whatever stays is the key's latest event.
    """
    at = F.struct(*order)
    latest = events.groupBy(key).agg(
        F.max(at).alias("last_at"), F.max(F.when(F.col("rating") == "down", at)).alias("last_down")
    )
    later_ups = (
        events.where(F.col("rating") == "up")
        .join(latest.select(key, "last_down"), key)
        .where(F.col("last_down").isNull() | (at > F.col("last_down")))
        .groupBy(key)
        .agg(F.count("*").alias("ups"))
    )
    kept = (
        latest.join(later_ups, key, "left")
        .where((F.coalesce("ups", F.lit(0)) % 2 == 1) | (F.coalesce("ups", F.lit(0)) == 0))
        .select(key, F.col("last_at").alias("_at"))
    )
    return events.withColumn("_at", at).join(kept, [key, "_at"], "left_semi").drop("_at")


def totals(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count_if(F.col("rating") == "up").alias("up"),
        F.count_if(F.col("rating") == "down").alias("down"),
        F.count_if(F.coalesce(F.col("correction"), F.lit("")) != "").alias("corrected"),
    )


def _approved(rated: DataFrame) -> DataFrame:
    corrected = (F.col("rating") == "down") & (F.coalesce(F.col("correction"), F.lit("")) != "")
    return rated.where((F.col("intent") == "qa") & ((F.col("rating") == "up") | corrected)).withColumn(
        "approved", F.when(F.col("rating") == "down", F.col("correction")).otherwise(strip_citations(F.col("answer")))
    )


def _term_key(text: Column) -> Column:
    """A text's distinct terms, sorted, as one string; terms hold letters and digits only."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")


# Term sets of questions and rows of records that one task compares, and term sets it looks up at a time.
SLICE = 32768
BLOCK = 131072
BATCH = 16


def _front_rows(least: float, schema: pa.Schema):
    """Compares a slice of term sets with a block of records by the block's term lists.

    Two sets of given sizes must share so many terms; a third of these are among the question's terms that stay
    when as many of its commonest as the other two thirds are left out. So only those lists are read, each up to the
    record size from which its term may be left out, and what is met often enough is compared in full.

    Of each term set's similar records, best first, the first is passed on, and of the others each that costs less
    than all before it: whatever room the best of all blocks leaves, the next that fits is among these.
    """
    record_id, batch = schema.names[1], BATCH

    def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The whole numbers from each start on, as many as its count says, one run after the other."""
        return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())

    def run(records: pa.Table, asked: pa.Table) -> pa.Table:
        if not records.num_rows or not asked.num_rows:
            return schema.empty_table()
        records = records.sort_by(record_id).combine_chunks()
        keys = records["right_key"].combine_chunks().dictionary_encode()
        cost = records["cost"].to_numpy()
        # Keys are numbered by their size, so the sizes in a term's list ascend.
        terms = pc.split_pattern(keys.dictionary, " ")
        by_size = np.argsort(pc.list_value_length(terms).to_numpy(), kind="stable")
        terms = terms.take(pa.array(by_size))
        sizes = pc.list_value_length(terms).to_numpy().astype(np.int64)
        n, longest = len(sizes), int(sizes[-1])
        key_of = np.argsort(by_size)[keys.indices.to_numpy()]
        by_key = np.argsort(key_of, kind="stable")
        key_rows = np.bincount(key_of, minlength=n)
        key_starts = np.cumsum(key_rows) - key_rows
        named = terms.flatten().dictionary_encode()
        term = named.indices.to_numpy().astype(np.int64)
        term_starts = np.cumsum(sizes) - sizes
        pairs = np.sort(term * n + np.repeat(np.arange(n), sizes))
        lists = (pairs % n).astype(np.int32 if batch * n < 2**31 else np.int64)
        first_of = np.searchsorted(sizes, np.arange(longest + 2))
        # Term sets by size, each one's known terms from the longest list on.
        texts = asked["left_key"].combine_chunks()
        width = pc.list_value_length(pc.split_pattern(texts, " ")).to_numpy()
        texts = texts.take(pa.array(np.argsort(width, kind="stable")))
        words = pc.split_pattern(texts, " ")
        width = pc.list_value_length(words).to_numpy().astype(np.int64)
        own = pc.fill_null(pc.index_in(words.flatten(), value_set=named.dictionary), -1).to_numpy().astype(np.int64)
        q = np.repeat(np.arange(len(width)), width)[own >= 0]
        own = own[own >= 0]
        order = np.lexsort((-np.bincount(term)[own], q))
        q, own = q[order], own[order]
        known = np.bincount(q, minlength=len(width))
        rank = np.arange(len(q)) - (np.cumsum(known) - known)[q]
        # Terms to share, by size of the term set (rows) and of the record; a little low, for the division below decides.
        asked_sizes, row = np.unique(width, return_inverse=True)
        needs = np.maximum(np.ceil(least * (asked_sizes[:, None] + np.arange(longest + 1)) / (1 + least) - 1e-9), 1).astype(np.int64)
        enough = (needs + 2) // 3
        ranks = np.arange(int(known.max()) + 1)
        counted = np.stack([np.searchsorted(x, ranks, side="right") for x in needs - enough])
        possible = np.stack([np.searchsorted(x, ranks, side="right") for x in needs])
        smallest = np.minimum(np.maximum(np.ceil(least * asked_sizes - 1e-9), 1).astype(np.int64), longest + 1)
        up_to = first_of[np.minimum(counted[row[q], rank], possible[row[q], known[q]])]
        starts = np.searchsorted(pairs, own * n + first_of[smallest][row[q]])
        ends = np.maximum(np.searchsorted(pairs, own * n + up_to), starts)
        times = enough[np.arange(len(asked_sizes)), np.minimum(smallest, longest)][row]
        seen = np.zeros((batch, len(named.dictionary)), bool)
        found = []
        for first in range(0, len(width), batch):
            a, b = np.searchsorted(q, (first, first + batch)).tolist()
            if (ends[a:b] == starts[a:b]).all():
                continue
            mine = q[a:b] - first
            met = np.concatenate([lists[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
            met = np.sort(met + np.repeat((mine * n).astype(met.dtype), ends[a:b] - starts[a:b]))
            # Sorted, what is met t times is equal to what stands t - 1 places on.
            t = int(times[first : first + batch].min())
            at = np.flatnonzero(met[t - 1 :] == met[: max(len(met) - t + 1, 0)])
            at = at[np.concatenate([[True], met[at[1:]] != met[at[:-1]]])] if len(at) else at
            of, key = np.divmod(met[at].astype(np.int64), n)
            further = at + enough[row[first + of], sizes[key]] - 1
            often = met[np.minimum(further, len(met) - 1)] == met[at]
            often &= further < len(met)
            of, key = of[often], key[often]
            if not len(of):
                continue
            size = sizes[key]
            seen[mine, own[a:b]] = True
            both = seen[np.repeat(of, size), term[runs(term_starts[key], size)]]
            seen[mine, own[a:b]] = False
            shared = np.add.reduceat(both, np.cumsum(size) - size, dtype=np.int64)
            similarity = shared / (width[first + of] + size - shared)
            near = similarity >= least
            found.append((first + of[near], key[near], similarity[near]))
        if not sum(len(x) for x, _, _ in found):
            return schema.empty_table()
        q, key, similarity = (np.concatenate(x) for x in zip(*found, strict=True))
        at = by_key[runs(key_starts[key], key_rows[key])]
        q, similarity = np.repeat(q, key_rows[key]), np.repeat(similarity, key_rows[key])
        order = np.lexsort((at, -similarity, q))
        q, at, similarity = q[order], at[order], similarity[order]
        kept = np.concatenate([[True], q[1:] != q[:-1]])
        # The least cost among the others so far; a term set's numbers are all below those of the one before it.
        above = int(cost.max()) + 2
        spent = cost[at] - q * above
        before = np.minimum.accumulate(np.where(kept, above - 1 - q * above, spent))
        kept[1:] |= spent[1:] < before[:-1]
        q, at, similarity = q[kept], at[kept], similarity[kept]
        columns = [texts.take(pa.array(q)), records[record_id].take(pa.array(at)), pa.array(cost[at]), pa.array(similarity)]
        return pa.table(columns, names=schema.names).cast(schema)

    return run


def similar_records(asked: DataFrame, front: DataFrame, record_id: str, least: float) -> DataFrame:
    """(left_key, record, cost, similarity): of the records with a Jaccard similarity of at least ``least`` those
    that can be a term set's best or, beside it, the best that fits.

    ``asked`` has distinct ``left_key``, ``front`` the records' ``right_key`` and cost; a key is the sorted terms.
    Slices of term sets meet blocks of records, so neither side is ever in one task, and no pair that is not
    similar leaves its task.
    """
    spark = asked.sparkSession
    n, m = asked.count(), front.count()
    slices = max(1, -(-n // SLICE), min(spark.sparkContext.defaultParallelism, -(-n // 512)))
    blocks = max(1, -(-m // BLOCK))
    tasks = min(4 * slices * blocks, 2000)

    def dealt(rows: DataFrame, part: Column) -> DataFrame:
        return rows.withColumn("part", part).repartition(tasks, "part")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    a_slice = F.pmod(F.xxhash64("left_key"), F.lit(slices))
    left = dealt(asked.select("left_key", each(blocks).alias("other")), a_slice * blocks + F.col("other")).drop("other")
    a_block = F.pmod(F.xxhash64("right_key"), F.lit(blocks))
    right = dealt(front.select("right_key", record_id, "cost", each(slices).alias("other")), F.col("other") * blocks + a_block).drop("other")
    kinds = {f.name: f.dataType for f in front.schema}
    schema = StructType(
        [StructField("left_key", StringType()), StructField(record_id, kinds[record_id]), StructField("cost", kinds["cost"]), StructField("similarity", DoubleType())]
    )
    run = _front_rows(least, to_arrow_schema(schema))
    return right.groupBy("part").cogroup(left.groupBy("part")).applyInArrow(run, schema)


def select_examples(
    questions: DataFrame,
    rated: DataFrame,
    question_id: str = "question_id",
    record_id: str = "id",
    least: float = MIN_SIMILARITY,
    most_tokens: int = EXAMPLE_TOKENS,
) -> DataFrame:
    """The two approved answers to the most similar questions (Jaccard of terms) within a budget.

    The best one is taken, then the best that still fits. Questions and records are reduced to
    their distinct term sets first; of records with the same terms and cost (a whole number up to
    the budget) only the two lowest ids can ever be taken, so copies never multiply.
    """
    approved = _approved(rated).select(
        record_id,
        "question",
        "approved",
        (token_estimate(F.col("question")) + token_estimate(F.col("approved")) + 8).alias("cost"),
        _term_key(F.col("question")).alias("right_key"),
    )
    # An example over the budget on its own can never be taken.
    approved = approved.where(F.col("cost") <= most_tokens)
    twins = Window.partitionBy("right_key", "cost").orderBy(record_id)
    front = (
        approved.select(record_id, "right_key", "cost")
        .withColumn("n", F.row_number().over(twins))
        .where(F.col("n") <= EXAMPLES)
        .drop("n")
    )
    # Read several times; the texts are cut once.
    front = stored(front.where("right_key <> ''"), "example-records")
    asked = stored(questions.select(question_id, _term_key(F.col("text")).alias("left_key")), "asked-terms")
    scored = stored(similar_records(asked.where("left_key <> ''").select("left_key").distinct(), front, record_id, least), "similar-records")
    order = Window.partitionBy("left_key").orderBy(F.desc("similarity"), record_id)
    best = scored.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    room = best.select(
        "left_key", F.col(record_id).alias("taken"), (F.lit(most_tokens) - F.col("cost")).alias("room")
    )
    second = (
        scored.join(room, "left_key")
        .where((F.col("cost") <= F.col("room")) & (F.col(record_id) != F.col("taken")))
        .withColumn("n", F.row_number().over(order))
        .where("n = 1")
        .drop("room", "taken", "n")
    )
    chosen = best.withColumn("place", F.lit(1)).unionByName(second.withColumn("place", F.lit(2)))
    return (
        asked.join(chosen, "left_key")
        .drop("left_key")
        .join(approved.select(record_id, "question", "approved"), record_id)
    )


def eval_candidates(state: DataFrame) -> DataFrame:
    """Corrected answers as evaluation items for review."""
    keep = (F.col("rating") == "down") & (F.coalesce("correction", F.lit("")) != "") & (F.col("intent") == "qa")
    return state.where(keep).select(
        F.col("doc"),
        F.col("question").alias("q"),
        F.array("correction").alias("expect"),
        "reasons",
        F.col("answer").alias("rejected_answer"),
    )
