"""Helpers of the training-data operators: lineage cuts, text keys, filters that return documents."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows of an id and a text key that may be sent to every executor: 16 bytes each, so 8 MB at most.
BROADCAST_KEYS = 500_000


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir``, with its lineage cut there.

    A session on one machine, as in tests, gets a temporary folder where that setting is absent; on a
    cluster a missing setting is an error, because executors share no local folder.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="parchment-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


SALTS = 64


def salt_of(doc_id: Column) -> Column:
    """One of ``SALTS`` numbers, by the id alone."""
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")


def salt_set(salt: str) -> Column:
    """Aggregate: the salts that occur, as bits of one long."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt})"))


def salts_in(bits: str) -> Column:
    """The salts of a ``salt_set``, one row each."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit({bits}, i) = 1)"))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    mark = unused("_key_text", docs)
    return docs.withColumn(mark, text_key(F.coalesce(docs["text"], F.lit("")))), mark


def _match(rows: DataFrame, mark: str, keys: DataFrame, how: str) -> DataFrame:
    return rows.join(keys, rows["doc_id"].eqNullSafe(keys["key_id"]) & (rows[mark] == keys["key_text"]), how)


def _small(keys: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most ``BROADCAST_KEYS`` rows of an id and a text key."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def drop_rows(docs: DataFrame, keys: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text key) is not in ``keys`` (columns key_id, key_text).

    Columns are those of ``docs``; null ids match null ids. Rows in ``repeated`` (the same columns), which
    repeat both id and text, come back once, with the least of their other columns by a hash. Few keys, counted first, go
    to every executor and the texts stay where they are; beyond ``BROADCAST_KEYS`` the join shuffles.
    """
    keys = checkpoint(keys.select("key_id", "key_text"))
    rows, mark = _keyed(docs)
    if repeated is not None:
        repeated = checkpoint(repeated.select("key_id", "key_text"))
        if repeated.isEmpty():
            repeated = None
    if repeated is None:
        return _match(rows, mark, _small(keys), "left_anti").drop(mark)
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    place = unused("_place", rows)
    same = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*rest) if rest else F.lit(0))
    once = _match(rows, mark, _small(repeated), "left_semi").withColumn(place, F.row_number().over(same))
    others = _match(rows, mark, _small(keys.unionByName(repeated)), "left_anti")
    return others.unionByName(once.where(F.col(place) == 1).drop(place)).drop(mark)
