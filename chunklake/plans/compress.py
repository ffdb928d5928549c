"""The compress pipeline: files to chunks, store, layout, dictionary, archive; and the disc pipeline's tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.functions.codec import with_codec
from chunklake.operators import dedup, layout, tuning
from chunklake.operators.chunking import chunks_of_files, content_chunks
from chunklake.operators.prefix import global_running_sum
from chunklake.session import merged, stage, tidy
from chunklake.sources.archive import CART, write_archive
from chunklake.sources.config import Settings
from chunklake.sources.files import digests_of_files, files_of_folders, organise_paths


@dataclass(frozen=True)
class Bundle:
    """What an archive holds: files (toc), manifest, and the unique chunks with their data and their place in the layout."""

    toc: DataFrame
    manifest: DataFrame
    store: DataFrame


def bundle(chunks: DataFrame, sized: DataFrame, name: str, ident: str) -> Bundle:
    """Chunks (ident, chunk_no, ...) and files (ident, name, uncompressed_size, sha512) to a bundle. Files are told apart by ident; one without chunks is kept.

    The layout is computed from the manifest's narrow rows; the data is shuffled once, by hash, where it is deduplicated and meets its place.
    """
    chunks = stage(chunks, "chunks")
    one = sized.select(ident, F.coalesce(F.col(name), F.lit("")).alias(name), "uncompressed_size", "sha512", F.lit(1).alias("_one"))
    toc = stage(global_running_sum(one, [F.col(name), F.col(ident)], "_one", "toc_no").withColumn("toc_no", F.col("toc_no") + 1).drop("_one"), "toc")
    manifest = stage(chunks.drop("chunk_data").join(merged(toc.select(ident, "toc_no")), ident), "manifest")
    lengths = manifest.groupBy("chunk_hash").agg(F.max("chunk_length").cast("long").alias("length"))
    order = layout.chunk_layout(manifest, lengths, "toc_no")
    store = dedup.store(chunks, order=(ident, "chunk_offset")).join(merged(order.select("chunk_hash", "position")), "chunk_hash")
    return Bundle(toc, manifest, stage(store, "store"))


def compress(files: DataFrame, path: str, settings: Settings = Settings(), name: str = "file_name", ident: str = "file_id", content: str = "content") -> dict:
    """Writes the archive of the files (ident, name, content), one row each, and returns figures: files, chunks, bytes and parameters.

    An empty or null file is kept with no chunks. The data is shuffled twice: by hash, where it is deduplicated, and compressed by range of the
    layout, where it is written. What the layout and the offsets need are narrow rows.
    """
    sized = files.select(ident, name, F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("uncompressed_size"), F.sha2(F.coalesce(F.col(content), F.lit(b"")), 512).alias("sha512"))
    cut = lambda window: content_chunks(files.select(ident, content), content, [ident], window, settings.normalisation, settings.hash_bits)
    return _write(cut, sized, path, settings, name, ident)


def compress_files(spark: SparkSession, paths: list[str], path: str, settings: Settings = Settings(), range_bytes: int = 8 << 20) -> dict:
    """The same for files on disk (the files of folders, not walked), of any size: tasks read them by ranges."""
    files, folders = organise_paths(paths)
    found = files + files_of_folders(folders)
    sized = digests_of_files(spark, found).withColumnRenamed("size", "uncompressed_size")
    some = [p for p in found if os.path.getsize(p)]
    cut = lambda window: chunks_of_files(spark, some, window, settings.normalisation, settings.hash_bits, range_bytes=range_bytes)
    return _write(cut, sized, path, settings, "name", "path")


def _write(cut: Callable[[int], DataFrame], sized: DataFrame, path: str, settings: Settings, name: str, ident: str) -> dict:
    settings = settings.checked()
    window, size = settings.sizes()
    if settings.auto_tune:
        largest = sized.agg(F.coalesce(F.max("uncompressed_size"), F.lit(0))).first()[0]
        make = lambda w: stage(dedup.store(cut(w), order=(ident, "chunk_offset")), "trial")
        window = tuning.best(tuning.tune_window(make, largest, settings.level, settings.tune_timeout)).parameter
        size = tuning.best(tuning.tune_dictionary(make(window), settings.level, settings.tune_timeout)).parameter
    tidy(sized.sparkSession)
    b = bundle(cut(window), sized, name, ident)
    tidy(sized.sparkSession)
    d = tuning.dictionary(b.store, size, optimise=settings.optimise_dictionary, cap=settings.dictionary_sample)
    packed = with_codec(b.store.select("chunk_hash", "position", "chunk_data"), "chunk_data", "compressed", "compress", d, settings.level).drop("chunk_data")
    packed = stage(packed.withColumn("compressed_length", F.octet_length("compressed")), "packed")
    placed = global_running_sum(packed.drop("compressed"), [F.col("position")], "compressed_length", "data_offset")
    n, total = b.toc.agg(F.count(F.lit(1)), F.coalesce(F.sum("uncompressed_size"), F.lit(0))).first()
    tables = {
        "toc": b.toc.select(F.col("toc_no").alias("seq"), "toc_no", F.col(name).alias("filename"), "uncompressed_size", "sha512", F.lit(None).cast("int").alias("collection_id")),
        "manifest": b.manifest.select(F.col("toc_no").alias("seq"), "toc_no", "chunk_no", "chunk_hash", "chunk_offset", "chunk_length"),
        "index": placed.select(F.col("position").alias("seq"), "chunk_hash", "data_offset", "compressed_length", F.lit(0).alias("codec")),
    }
    tidy(packed.sparkSession)
    write_archive(path, tables, packed.select(F.col("position").alias("seq"), F.col("compressed").alias("payload")), d, n, settings.hash_bits, CART, settings.force)
    c, packed_bytes = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("compressed_length"), F.lit(0))).first()
    return {"files": n, "bytes": total, "unique_chunks": c, "compressed_bytes": packed_bytes, "window": window, "dictionary": len(d)}


def chunk_numbers(manifest: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Numbers a manifest's rows within their file, from 0."""
    return manifest.withColumn("chunk_no", (F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1).cast("int"))
