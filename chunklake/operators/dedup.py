"""The chunk store: dedup by hash, frequencies, keys, sizes, duplicates of whole values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def store(chunks: DataFrame, key: str = "chunk_hash", data: str = "chunk_data", order: tuple[str, ...] = ("file_id", "chunk_offset")) -> DataFrame:
    """One row for each hash with the data of its first occurrence by `order`: deterministic, folded before the shuffle.

    Rows without a hash are no chunks. Null data loses against any data.
    """
    first = F.struct(F.col(data).isNull().alias("none"), *[F.col(c) for c in order])
    return chunks.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.col(data), first).alias(data), F.count(F.lit(1)).alias("frequency"))


def frequencies(chunks: DataFrame, key: str = "chunk_hash") -> DataFrame:
    return chunks.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("frequency"))


def keys(chunks: DataFrame, key: str = "chunk_hash") -> DataFrame:
    return chunks.filter(F.col(key).isNotNull()).select(key).distinct()


def unique_bytes(chunks: DataFrame, length: Column, key: str = "chunk_hash") -> DataFrame:
    """One row: (chunks, unique_chunks, bytes, unique_bytes, dedup_ratio); the ratio is null without chunks."""
    each = chunks.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("all"), F.max(length).alias("one"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = each.agg(z(F.sum("n")).alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), z(F.sum("all")).alias("bytes"), z(F.sum("one")).alias("unique_bytes"))
    return got.withColumn("dedup_ratio", F.col("bytes") / F.nullif("unique_bytes", F.lit(0)))


def collisions(chunks: DataFrame, key: str = "chunk_hash", data: str = "chunk_data") -> DataFrame:
    """Hashes with more than one content, by SHA-256: (key, contents). None, unless hashes collide or data is damaged."""
    return chunks.filter(F.col(key).isNotNull() & F.col(data).isNotNull()).groupBy(key, F.sha2(F.col(data), 256).alias("d")).agg(F.lit(1).alias("one")).groupBy(key).agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")


def duplicate_groups(df: DataFrame, data: Column, ident: str) -> DataFrame:
    """(digest, copies, first_id) of contents that occur more than once; null data is no content."""
    return df.filter(data.isNotNull()).groupBy(F.md5(data.cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id")).filter("copies > 1")
