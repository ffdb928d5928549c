"""Per-key results where a handful of keys hold most rows (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions.keys import canonical_key, key_as_long, long_as_key


def key_totals(
    messages: DataFrame,
    key: str = "chunk_hash",
    owner: str = "file_id",
    data: str = "chunk_data",
) -> DataFrame:
    """Messages, distinct owners and data bytes of each key: (chunk_hash, messages, files, bytes).

    Map-side combining: the first aggregate is keyed by (key, owner), and each task's bounded hash table (which spills)
    folds a hot key's rows to one row for each owner before anything is shuffled; the shuffled rows of a hot key spread over
    all tasks, since the owner is part of the hash. The second aggregate folds those rows again before the second
    shuffle, so a key that holds a third of all rows reaches its last task as one compact partial for each map task.
    Only algebraic states move: two counts and a sum, never rows, data or sets of owners.

    Rows without a key (null, or no 64-bit hexadecimal number) belong to no key. A null owner counts as no file, null data as
    0 bytes; equal rows each count. The claimed size is not used. An empty table gives no rows. Extra columns don't matter.
    """
    rows = messages.select(
        key_as_long(canonical_key(F.col(key))).alias("k"),
        F.col(owner).alias("o"),
        F.coalesce(F.octet_length(F.col(data)), F.lit(0)).cast("long").alias("b"),
    ).filter(F.col("k").isNotNull())
    by_owner = rows.groupBy("k", "o").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    return (
        by_owner.groupBy("k")
        .agg(F.sum("n").alias("messages"), F.count("o").alias("files"), F.sum("b").alias("bytes"))
        .select(long_as_key(F.col("k")).alias("chunk_hash"), "messages", "files", "bytes")
    )


def heavy_keys(messages: DataFrame, share: float = 0.01, key: str = "chunk_hash", owner: str = "file_id", data: str = "chunk_data") -> DataFrame:
    """The rows of key_totals whose key holds at least `share` of all rows, rows without a key included in the total.

    Ties at the limit are kept. An empty table gives no rows.
    """
    total = messages.agg(F.count(F.lit(1)).alias("n")).scalar()
    return key_totals(messages, key, owner, data).filter(F.col("messages") >= total * F.lit(share))
