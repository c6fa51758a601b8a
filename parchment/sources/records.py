"""Keyed records: upsert, delete, newest-first scan, sealing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, changes: DataFrame, key: str = "id", updated: str = "updated_at") -> DataFrame:
    """Newest row per key of both tables; a change wins over a stored row of the same time.

    A key's newest row is a maximum, so repeats of one key combine before the shuffle.
    """
    fields = [c for c in stored.columns if c not in (key, updated)]
    tagged = stored.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    newest = tagged.groupBy(key).agg(F.max(F.struct(updated, "_change", *fields)).alias("row"))
    return newest.select(key, *[F.col(f"row.{c}").alias(c) for c in stored.columns if c != key])


def delete(stored: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(removed.select(key).distinct(), key, "left_anti")


def newest_first(stored: DataFrame, updated: str = "updated_at") -> DataFrame:
    return stored.orderBy(F.desc(updated))


def seal(stored: DataFrame, secret: Column, key: str = "id", updated: str = "updated_at") -> DataFrame:
    """Everything but the key and time as one AES-GCM value."""
    fields = [c for c in stored.columns if c not in (key, updated)]
    return stored.select(key, updated, F.aes_encrypt(F.to_json(F.struct(*fields)), secret, F.lit("GCM")).alias("sealed"))


def open_sealed(
    sealed: DataFrame, schema: str, secret: Column | None, key: str = "id", updated: str = "updated_at"
) -> DataFrame:
    """Plain rows as they are and sealed rows opened. ``unopened`` gives the sealed rows that the secret
    does not open, or all of them without one."""
    read = _read_sealed(sealed, schema, secret)
    fields = [f.split()[0] for f in schema.split(", ")]
    plain = lambda f: F.col(f) if f in sealed.columns else F.lit(None)
    opened = read.where(F.col("sealed").isNull() | F.col("_record").isNotNull())
    return opened.select(key, updated, *[F.when(F.col("sealed").isNull(), plain(f)).otherwise(F.col(f"_record.{f}")).alias(f) for f in fields])


def unopened(sealed: DataFrame, schema: str, secret: Column | None) -> DataFrame:
    return _read_sealed(sealed, schema, secret).where("sealed is not null and _record is null").drop("_record")


def _read_sealed(sealed: DataFrame, schema: str, secret: Column | None) -> DataFrame:
    clear = F.lit(None) if secret is None else F.try_aes_decrypt("sealed", secret, F.lit("GCM"))
    return sealed.withColumn("_record", F.from_json(clear.cast("string"), schema))
