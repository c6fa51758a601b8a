"""Session settings, the shared work folder, and the size check in front of every broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes a side may have before it is sent to every executor.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. On a cluster the submitter's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parchment")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent a session on one machine, as in tests, gets a temporary folder; on
    a cluster it is an error, since executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="parchment-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes: texts by their
    length, other nested values by that of their JSON, everything else eight bytes a column. Reads
    no more than one row past the bound."""
    width = F.lit(8 * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width += F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0))
    size = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of rows and bytes. Past the bounds the join stays a shuffle join
    and AQE splits its skewed partitions."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: for a small result of a costly scan
    that several aggregates need. Unlike cached rows it outlives its executors."""
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
