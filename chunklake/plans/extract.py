"""Reading archives: listing, selection, byte ranges, whole files, verification."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions.codec import with_codec
from chunklake.functions.hashing import hash_hex
from chunklake.functions.scalars import human_size, parse_index_list
from chunklake.operators.concat import concatenated
from chunklake.operators.seek import out_of_bounds, seek
from chunklake.operators.verify import digests
from chunklake.sources.ranges import filesystem
from chunklake.sources.archive import fetch_chunks, read_archive, read_header


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(index, filename, size, collection_id): reads the table of contents only."""
    return read_archive(spark, path, "toc").select(F.col("toc_no").alias("index"), "filename", F.col("uncompressed_size").alias("size_bytes"), human_size(F.col("uncompressed_size")).alias("size"), "collection_id")


def listing_json(toc: DataFrame, index: str = "index", name: str = "filename", size: str = "size_bytes") -> DataFrame:
    """(index, json): one JSON object for each entry; joined by commas in order they are the whole list."""
    return toc.select(index, F.to_json(F.struct(F.col(index).alias("index"), F.col(name).alias("filename"), F.col(size).alias("size(bytes)"))).alias("json"))


def selected(spark: SparkSession, path: str, indices: str | None) -> DataFrame:
    """The table of contents, or the entries of an index list as 1,3,5-7; an index over the file count is an error."""
    toc = read_archive(spark, path, "toc")
    return toc if indices is None else toc.filter(F.col("toc_no").isin(parse_index_list(indices, read_header(path)["file_count"])))


def _plain(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    d = bytes(read_archive(spark, path, "dictionary").first()[0])
    return with_codec(fetch_chunks(spark, path, wanted), "compressed", "chunk_data", "stored", d).select("chunk_hash", "chunk_data")


def chunk_rows(spark: SparkSession, path: str, toc: DataFrame) -> DataFrame:
    """The selected files' manifest rows with their chunks' data."""
    rows = read_archive(spark, path, "manifest").join(toc.select("toc_no"), "toc_no", "left_semi")
    return rows.join(_plain(spark, path, rows), "chunk_hash", "left")


def verify(spark: SparkSession, path: str, indices: str | None = None) -> DataFrame:
    """(toc_no, filename, ok) of the files: each chunk against its hash, each file against its stored SHA-512."""
    toc = selected(spark, path, indices)
    got = digests(chunk_rows(spark, path, toc), "toc_no").withColumnRenamed("file_id", "toc_no")
    ok = (F.col("uncompressed_size") == 0) | F.coalesce((F.col("t.sha512") == F.col("g.sha512")) & (F.col("damaged") == 0) & (F.col("missing") == 0), F.lit(False))
    return toc.alias("t").join(got.alias("g"), "toc_no", "left").select("toc_no", "filename", ok.alias("ok"))


def read_ranges(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """(request_id, bytes) of requests (request_id, toc_no, seek_offset, seek_length); one beyond its file's end is an error."""
    toc = read_archive(spark, path, "toc")
    if (bad := out_of_bounds(requests, toc, "toc_no", "uncompressed_size").first()) is not None:
        raise ValueError(f"out of bounds: {bad.asDict()}")
    parts = seek(read_archive(spark, path, "manifest"), requests, "toc_no")
    data = parts.join(_plain(spark, path, parts), "chunk_hash")
    piece = F.col("chunk_data").substr((F.col("slice_start") + 1).cast("int"), (F.col("slice_end") - F.col("slice_start")).cast("int"))
    got = concatenated(data.withColumn("_piece", piece), ["request_id"], "chunk_offset", "_piece", "bytes")
    return requests.select("request_id").join(got, "request_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(b"")))


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, temp, size = None, None, None, 0
        own, inside = filesystem(folder)

        def close() -> tuple:
            out.close()
            own.move(temp, f"{inside}/{now[1]}")
            return (*now, size)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["toc_no", "filename", "size"])

        for rb in batches:
            done = []
            for n, name, key, d in zip(*(rb.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if (n, name) != now:
                    if now is not None:
                        done.append(close())
                    now, size = (n, name), 0
                    temp = f"{inside}/.{uuid.uuid4().hex}.part"
                    out = own.open_output_stream(temp)
                if key is None:
                    continue
                if d is None or hash_hex(d, 4 * len(key)) != key:
                    out.close()
                    own.delete_file(temp)
                    raise ValueError(f"chunk {key} of {name} is missing or damaged")
                out.write(d)
                size += len(d)
            if done:
                yield batch(done)
        if now is not None:
            yield batch([close()])

    return run


def extract(spark: SparkSession, path: str, folder: str, indices: str | None = None, force: bool = False) -> DataFrame:
    """Writes the selected files into a folder all executors share, each under a temporary name first; (toc_no, filename, size).

    Every chunk is checked against its hash; a damaged one stops the job. Two files of one name get their index before the name.
    """
    own, inside = filesystem(folder)
    if own.get_file_info(inside).type != fs.FileType.Directory:
        if not force:
            raise FileNotFoundError(folder)
        own.create_dir(inside)
    toc = selected(spark, path, indices)
    twice = toc.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    plain = F.regexp_replace(F.when(F.col("filename") == "", F.lit("unnamed")).otherwise(F.col("filename")), r"[/\\\x00]", "_")
    named = toc.join(twice, "filename").select("toc_no", F.when((F.col("n") > 1) | (F.col("filename") != plain), F.concat(F.col("toc_no").cast("string"), F.lit("_"), plain)).otherwise(plain).alias("name"))
    rows = named.join(chunk_rows(spark, path, toc), "toc_no", "left").select("toc_no", "name", F.coalesce("chunk_offset", F.lit(0)).alias("o"), "chunk_hash", "chunk_data")
    return rows.repartition("toc_no").sortWithinPartitions("toc_no", "o").mapInArrow(_write_batches(folder), "toc_no long, filename string, size long")
