"""Byte-range seeks over manifests: which slices of which chunks hold a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.operators.joins import interval_join


def seek(manifest: DataFrame, requests: DataFrame, file: str = "file_id", offset: str = "chunk_offset", length: str = "chunk_length", bucket: int = 8192) -> DataFrame:
    """Fragments of each request (request_id, file, seek_offset, seek_length): the request's columns, the chunk's, and
    slice_start (in the chunk, inclusive) and slice_end (exclusive).

    A request of length 0 strictly inside a chunk gives one empty fragment, on a border none. Requests beyond the end
    are given by out_of_bounds and have here what there is. Requests meet chunks by file and bucket of bytes.
    """
    r = requests.withColumn("_to", F.col("seek_offset") + F.col("seek_length"))
    m = manifest.withColumn("_end", F.col(offset) + F.col(length))
    got = interval_join(m, r, [file], offset, "_end", "seek_offset", "_to", bucket)
    return got.withColumn("slice_start", F.greatest(F.col("seek_offset") - F.col(offset), F.lit(0)).cast("long")).withColumn("slice_end", F.least(F.col("_to") - F.col(offset), F.col(length)).cast("long")).drop("_to", "_end")


def out_of_bounds(requests: DataFrame, sizes: DataFrame, file: str = "file_id", size: str = "size") -> DataFrame:
    """Requests that reach beyond their file, or whose file is unknown. The sum is decimal and can't overflow."""
    end = F.col("seek_offset").cast("decimal(20,0)") + F.col("seek_length").cast("decimal(20,0)")
    return requests.join(sizes.select(file, size), file, "left").filter(F.col(size).isNull() | (end > F.col(size)) | (F.col("seek_offset") < 0) | (F.col("seek_length") < 0))
