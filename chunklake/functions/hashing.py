"""Content hashes: xxh3 (seeded, 64 and 128 bit) through Arrow, SHA-512 and MD5 in the JVM."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the seed of all chunk hashes.
CHUNK_SEED = 0x4202803010192019


def hash_hex(data: bytes, bits: int = 64, seed: int = CHUNK_SEED) -> str:
    """A chunk's id as fixed-width big-endian hex, so that text order is unsigned numeric order."""
    return (xxhash.xxh3_64_hexdigest if bits == 64 else xxhash.xxh3_128_hexdigest)(data, seed=seed)


def chunk_hash(data: Column, bits: int = 64, seed: int = CHUNK_SEED) -> Column:
    """xxh3 of binary data as lower-case hex of 16 or 32 digits; null gives null."""
    if bits not in (64, 128):
        raise ValueError("hash width is 64 or 128 bits")

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else hash_hex(bytes(v), bits, seed) for v in x], dtype=object)

    return run(data)


def integrity_hash(data: Column) -> Column:
    """Unseeded xxh3-64, the whole-image check."""
    return chunk_hash(data, 64, 0)


def digests(data: Column) -> Column:
    """STRUCT<sha512, xxh3>: both digests of the data in one pass over the row."""
    return F.struct(F.sha2(data, 512).alias("sha512"), integrity_hash(data).alias("xxh3"))
