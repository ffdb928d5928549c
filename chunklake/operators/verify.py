"""Reassembly and verification: ordered concatenation of chunks, digests against the originals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions.hashing import hash_hex
from chunklake.operators.concat import concatenated


def with_chunks(manifest: DataFrame, chunks: DataFrame, key: str = "chunk_hash", data: str = "chunk_data") -> DataFrame:
    """The manifest's rows with their chunk's data; repeats and order stay (sort by offset later), a missing chunk has null data."""
    return manifest.join(chunks.select(key, data), key, "left")


def reassembled(rows: DataFrame, file: str = "file_id", offset: str = "chunk_offset", data: str = "chunk_data") -> DataFrame:
    """(file, content): each file's chunks, one after the other, for files that fit a row; digests() takes any size."""
    return concatenated(rows, [file], offset, data, "content")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_id", "size", "chunks", "sha512", "md5", "damaged", "missing"]
    now, state = None, None

    def row():
        return (now, state[0], state[1], state[2].hexdigest(), state[3].hexdigest(), state[4], state[5])

    for rb in batches:
        out = []
        for f, key, d in zip(rb.column(0).to_pylist(), rb.column(2).to_pylist(), rb.column(3)):
            if f != now:
                if now is not None:
                    out.append(row())
                now, state = f, [0, 0, hashlib.sha512(), hashlib.md5(), 0, 0]
            raw = d.as_py()
            state[1] += 1
            if raw is None:
                state[5] += 1
                continue
            state[0] += len(raw)
            state[2].update(raw)
            state[3].update(raw)
            state[4] += key is not None and hash_hex(raw, 4 * len(key)) != key
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row()], names=names)


def digests(rows: DataFrame, file: str = "file_id", offset: str = "chunk_offset", key: str = "chunk_hash", data: str = "chunk_data") -> DataFrame:
    """(file_id, size, chunks, sha512, md5, damaged, missing) of each file rebuilt from its chunks, streamed in order of offset:
    no file is held whole. damaged counts chunks whose data doesn't have their hash, missing those without data."""
    picked = rows.select(F.col(file).cast("long").alias("file_id"), F.col(offset).cast("long").alias("o"), F.col(key).alias("k"), F.col(data).alias("d")).filter("file_id is not null")
    return picked.repartition("file_id").sortWithinPartitions("file_id", "o").mapInArrow(_digest_batches, "file_id long, size long, chunks long, sha512 string, md5 string, damaged long, missing long")


def verified(rows: DataFrame, originals: DataFrame, file: str = "file_id", content: str = "content", **cols) -> DataFrame:
    """(file_id, size, ok): whether each original (file, content) comes back with its SHA-512; empty originals have no chunks and
    are ok. A file without original isn't in the result."""
    want = originals.select(F.col(file).cast("long").alias("file_id"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("want_size"), F.sha2(F.coalesce(F.col(content), F.lit(b"")), 512).alias("want"))
    got = digests(rows, file, **cols)
    ok = (F.coalesce("size", F.lit(0)) == F.col("want_size")) & ((F.col("want_size") == 0) | F.coalesce((F.col("sha512") == F.col("want")) & (F.col("damaged") == 0) & (F.col("missing") == 0), F.lit(False)))
    return want.join(got, "file_id", "left").select("file_id", F.col("want_size").alias("size"), ok.alias("ok"))
