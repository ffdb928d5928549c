"""The core's queries and, where SQL can say them, their counterparts for another engine."""

from __future__ import annotations

import contextlib
import io
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.functions import codec, disc, scalars
from chunklake.functions.hashing import chunk_hash, digests as both_digests
from chunklake.functions.keys import canonical_key, canonical_key_sql
from chunklake.operators.concat import concatenated
from chunklake.operators import chunking, cue, dedup, joins, layout, optical, runs, seek, skew, tuning, verify
from chunklake.plans import compress, discs, extract
from chunklake.session import job, progress, shared_dir, stage, table
from chunklake.sources import config
from chunklake.sources import files as sources
from chunklake.sources.archive import local
from chunklake.sources.config import Settings
from chunklake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filedata").select("file_id", "file_name", "file_data")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's possible rows, each place of a file once."""
    m = table(spark, d, "manifest").filter("chunk_offset >= 0 and chunk_length >= 0")
    return m.groupBy("file_id", "chunk_no").agg(F.min(F.struct("chunk_offset", "chunk_length", "chunk_hash")).alias("c")).select("file_id", "chunk_no", "c.chunk_hash", "c.chunk_offset", "c.chunk_length")


_M = """m0 AS (SELECT file_id, chunk_no, min({'o': chunk_offset, 'l': chunk_length, 'h': coalesce(chunk_hash, '')}) AS c FROM manifest WHERE chunk_offset >= 0 AND chunk_length >= 0 GROUP BY ALL),
m AS (SELECT file_id, chunk_no, nullif(c.h, '') AS chunk_hash, c.o AS chunk_offset, c.l AS chunk_length FROM m0)"""
_BIG = "CAST({} AS BIGINT)"


def _big(x: str) -> str:
    return _BIG.format(x)


# Keys with most of the rows (problem 3)

_KEY = canonical_key_sql("chunk_hash")
_TOTALS = f"""SELECT k AS chunk_hash, count(*) AS messages, count(DISTINCT file_id) AS files, {_big("sum(coalesce(octet_length(chunk_data), 0))")} AS bytes
FROM (SELECT *, {_KEY} AS k FROM chunkmessage) WHERE k IS NOT NULL GROUP BY k"""


@query(f"SELECT chunk_hash FROM ({_TOTALS}) WHERE messages >= 0.01 * (SELECT count(*) FROM chunkmessage)")
def p3_found(spark, d):
    return skew.heavy_keys(table(spark, d, "chunkmessage")).select("chunk_hash")


@query(_TOTALS)
def p3_key_totals(spark, d):
    return skew.key_totals(table(spark, d, "chunkmessage"))


# Sources and listings

_TOC = f"SELECT {_big('row_number() OVER (ORDER BY file_name NULLS FIRST, file_id)')} AS toc_no, file_id, file_name, {_big('coalesce(octet_length(file_data), 0)')} AS size FROM filedata"


def _toc(spark, d):
    sized = _files(spark, d).select("file_id", "file_name", F.coalesce(F.octet_length("file_data"), F.lit(0)).cast("long").alias("size"))
    return layout.table_of_contents(sized, "file_name", "size", "file_id")


@query(_TOC)
def files_toc(spark, d):
    return _toc(spark, d)


@query(f"SELECT * FROM ({_TOC}) WHERE toc_no IN (1, 3, 5, 6, 7, 20)")
def index_range_select(spark, d):
    return _toc(spark, d).filter(F.col("toc_no").isin(scalars.parse_index_list("1,3,5-7,20")))


@query(f"SELECT ext, count(*) AS files, {_big('sum(n)')} AS bytes FROM (SELECT lower(regexp_extract(regexp_extract(coalesce(file_name, ''), '([^/\\\\]*)$', 1), '^.+\\.([^.]*)$', 1)) AS ext, coalesce(octet_length(file_data), 0) AS n FROM filedata) GROUP BY ext")
def files_by_ext(spark, d):
    return _files(spark, d).groupBy(scalars.extension(F.coalesce("file_name", F.lit(""))).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.octet_length("file_data"), F.lit(0))).cast("long").alias("bytes"))


@query(f"SELECT count(*) AS files, {_big('sum(octet_length(file_data))')} AS bytes, {_big('max(octet_length(file_data))')} AS largest FROM filedata")
def input_size_total(spark, d):
    n = F.octet_length("file_data").cast("long")
    return _files(spark, d).agg(F.count(F.lit(1)).alias("files"), F.sum(n).alias("bytes"), F.max(n).alias("largest"))


@query("SELECT file_id, CASE WHEN n IS NULL THEN NULL WHEN n >= 1048576 THEN regexp_replace(regexp_replace(printf('%.2f', round(n / 1048576.0, 2)), '0+$', ''), '\\.$', '') || ' MB' WHEN n >= 1024 THEN regexp_replace(regexp_replace(printf('%.2f', round(n / 1024.0, 2)), '0+$', ''), '\\.$', '') || ' KB' ELSE n || ' B' END AS size FROM (SELECT file_id, octet_length(file_data) AS n FROM filedata)")
def human_sizes(spark, d):
    return _files(spark, d).select("file_id", scalars.human_size(F.octet_length("file_data")).alias("size"))


@query("SELECT toc_no AS index, '{\"index\":' || toc_no || ',\"filename\":\"' || replace(replace(replace(file_name, '\\', '\\\\'), '\"', '\\\"'), chr(9), '\\t') || '\",\"size(bytes)\":' || size || '}' AS json FROM (" + _TOC + ") WHERE file_name IS NOT NULL")
def toc_json(spark, d):
    return extract.listing_json(_toc(spark, d).filter("file_name is not null").withColumnRenamed("toc_no", "index"), "index", "file_name", "size")


@query("SELECT file_id, coalesce(regexp_extract(file_name, '([^/\\\\]*)$', 1), '') AS base, CASE WHEN regexp_matches(regexp_extract(file_name, '([^/\\\\]*)$', 1), '^.+\\.[^.]*$') THEN regexp_extract(regexp_extract(file_name, '([^/\\\\]*)$', 1), '^(.+)\\.[^.]*$', 1) ELSE regexp_extract(file_name, '([^/\\\\]*)$', 1) END || '.bin' AS renamed FROM filedata WHERE file_name IS NOT NULL")
def path_parts(spark, d):
    return _files(spark, d).filter("file_name is not null").select("file_id", scalars.base_name(F.col("file_name")).alias("base"), scalars.with_extension(F.col("file_name"), "bin").alias("renamed"))


@query("SELECT manufacturer, system_name AS system, game_title AS game, count(*) AS files FROM gamelib JOIN filedata USING (game_id) WHERE manufacturer IS NOT NULL AND system_name IS NOT NULL AND game_title IS NOT NULL AND NOT regexp_matches(manufacturer || system_name || game_title, '[/\\\\]') GROUP BY ALL")
def library_tree(spark, d):
    g = table(spark, d, "gamelib").filter("manufacturer is not null and system_name is not null and game_title is not null").filter(~F.concat("manufacturer", "system_name", "game_title").rlike(r"[/\\]"))
    path = F.concat_ws("/", F.lit("root"), "manufacturer", "system_name", "game_title", F.concat(F.lit("f"), F.col("file_id")))
    return sources.library(table(spark, d, "filedata").select("file_id", "game_id").join(g, "game_id").select(path.alias("path"))).drop("paths")


@query(f"SELECT file_id, md5(unhex(substr(hex(file_data), 2 * (octet_length(file_data) // 3) + 1, 2 * (octet_length(file_data) // 3)))) AS piece_md5 FROM filedata WHERE octet_length(file_data) > 0")
def ranged_read(spark, d):
    n = F.expr("cast(octet_length(file_data) div 3 as int)")
    return _files(spark, d).filter("octet_length(file_data) > 0").select("file_id", F.md5(sources.ranged(F.col("file_data"), n, n)).alias("piece_md5"))


# Chunks, store, duplicates

_DOC_BLOCKS = "SELECT doc_id, CAST(i AS BIGINT) AS block_no, CAST(512 * i AS BIGINT) AS block_offset, substring(text, 512 * i + 1, 512) AS block FROM (SELECT doc_id, text, unnest(range((length(text) + 511) // 512)) AS i FROM documents WHERE length(text) > 0)"


def _doc_blocks(spark, d):
    return chunking.fixed_blocks(table(spark, d, "documents"), F.col("text"), ["doc_id"], 512)


@query(f"SELECT doc_id, block_no, block_offset, md5(block) AS block_md5 FROM ({_DOC_BLOCKS})")
def blocks_fixed(spark, d):
    return _doc_blocks(spark, d).select("doc_id", "block_no", "block_offset", F.md5(F.col("block").cast("binary")).alias("block_md5"))


@query(f"SELECT {_big('sum(n)')} AS chunks, count(*) AS unique_chunks, {_big('sum(n * l)')} AS bytes, {_big('sum(l)')} AS unique_bytes, sum(n * l) / CAST(sum(l) AS DOUBLE) AS dedup_ratio FROM (SELECT md5(block), count(*) AS n, max(octet_length(encode(block))) AS l FROM ({_DOC_BLOCKS}) GROUP BY 1)")
def blocks_dedup_ratio(spark, d):
    b = _doc_blocks(spark, d).select(F.md5(F.col("block").cast("binary")).alias("chunk_hash"), F.octet_length("block").cast("long").alias("l"))
    return dedup.unique_bytes(b, F.col("l"))


@query(f"SELECT h AS block_md5, f.d AS doc_id, f.o AS block_offset, frequency FROM (SELECT md5(block) AS h, min({{'d': doc_id, 'o': block_offset}}) AS f, count(*) AS frequency FROM ({_DOC_BLOCKS}) GROUP BY 1)")
def block_first_owner(spark, d):
    b = _doc_blocks(spark, d).select(F.md5(F.col("block").cast("binary")).alias("block_md5"), "doc_id", "block_offset")
    return b.groupBy("block_md5").agg(F.min(F.struct("doc_id", "block_offset")).alias("f"), F.count(F.lit(1)).alias("frequency")).select("block_md5", "f.doc_id", "f.block_offset", "frequency")


_FILE_BLOCKS = "SELECT file_id, CAST(i AS BIGINT) AS block_no, unhex(substr(hex(file_data), 2048 * i + 1, 2048)) AS block FROM (SELECT file_id, file_data, unnest(range((octet_length(file_data) + 1023) // 1024)) AS i FROM filedata WHERE octet_length(file_data) > 0)"


@query(f"SELECT file_id, block_no, md5(block) AS block_md5, {_big('octet_length(block)')} AS block_bytes FROM ({_FILE_BLOCKS})")
def file_blocks(spark, d):
    b = chunking.fixed_blocks(_files(spark, d), F.col("file_data"), ["file_id"], 1024)
    return b.select("file_id", "block_no", F.md5("block").alias("block_md5"), F.octet_length("block").cast("long").alias("block_bytes"))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_texts(spark, d):
    return dedup.duplicate_groups(table(spark, d, "documents"), F.col("text"), "doc_id")


@query("SELECT md5(file_data) AS digest, count(*) AS copies, min(file_id) AS first_id FROM filedata WHERE file_data IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_files(spark, d):
    return dedup.duplicate_groups(_files(spark, d), F.col("file_data"), "file_id")


def _keyed(spark, d):
    return table(spark, d, "chunkmessage").withColumn("chunk_hash", canonical_key(F.col("chunk_hash")))


@query(f"SELECT k AS chunk_hash, md5(arg_min(chunk_data, {{'n': chunk_data IS NULL, 'r': received_at, 'm': msg_id}})) AS data_md5, count(*) AS frequency FROM (SELECT *, {_KEY} AS k FROM chunkmessage) WHERE k IS NOT NULL GROUP BY k HAVING count(chunk_data) > 0")
def message_store(spark, d):
    got = dedup.store(_keyed(spark, d), order=("received_at", "msg_id"))
    return got.filter("chunk_data is not null").select("chunk_hash", F.md5("chunk_data").alias("data_md5"), "frequency")


@query(f"SELECT {_big('sum(n)')} AS chunks, count(*) AS unique_chunks, {_big('coalesce(sum(b), 0)')} AS bytes, {_big('coalesce(sum(o), 0)')} AS unique_bytes, sum(b) / CAST(sum(o) AS DOUBLE) AS dedup_ratio FROM (SELECT {_KEY} AS k, count(*) AS n, sum(octet_length(chunk_data)) AS b, max(octet_length(chunk_data)) AS o FROM chunkmessage GROUP BY 1) WHERE k IS NOT NULL")
def message_dedup_ratio(spark, d):
    return dedup.unique_bytes(_keyed(spark, d), F.octet_length("chunk_data").cast("long"))


@query(f"SELECT k AS chunk_hash, contents FROM (SELECT {_KEY} AS k, count(DISTINCT sha256(chunk_data)) AS contents FROM chunkmessage WHERE chunk_data IS NOT NULL GROUP BY 1) WHERE k IS NOT NULL AND contents > 1")
def key_collisions(spark, d):
    return dedup.collisions(_keyed(spark, d))


@query("SELECT DISTINCT chunk_hash FROM manifest WHERE chunk_hash IS NOT NULL")
def manifest_keys(spark, d):
    return dedup.keys(table(spark, d, "manifest"))


# Layout

@query(f"SELECT chunk_hash, count(*) AS frequency FROM manifest WHERE chunk_hash IS NOT NULL GROUP BY chunk_hash")
def chunk_freq(spark, d):
    return dedup.frequencies(table(spark, d, "manifest"))


_SCORE = f"""WITH {_M}, fr AS (SELECT chunk_hash, count(*) AS fq FROM m WHERE chunk_hash IS NOT NULL GROUP BY 1),
sc AS (SELECT file_id, {_big('coalesce(sum(fq), 0)')} AS score, count(*) AS chunks FROM m LEFT JOIN fr USING (chunk_hash) GROUP BY file_id),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_id) - 1 AS rank FROM sc)"""


@query(f"{_SCORE} SELECT * FROM sc")
def file_score(spark, d):
    return layout.file_scores(_manifest(spark, d))


@query(f"{_SCORE} SELECT * FROM rk")
def file_rank(spark, d):
    return layout.ranked_files(layout.file_scores(_manifest(spark, d)))


_LAYOUT = f"""{_SCORE}, fo AS (SELECT chunk_hash, min({{'r': rank, 'o': chunk_offset}}) AS a, max(chunk_length) AS length FROM m JOIN rk USING (file_id) WHERE chunk_hash IS NOT NULL GROUP BY chunk_hash),
ly AS (SELECT chunk_hash, length, row_number() OVER (ORDER BY a.r, a.o, chunk_hash) - 1 AS position FROM fo)
SELECT chunk_hash, position, {_big('length')} AS length, {_big('coalesce(sum(length) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS layout_offset FROM ly"""


@query(_LAYOUT)
def layout_offsets(spark, d):
    m = stage(_manifest(spark, d), "manifest")
    lengths = m.filter("chunk_hash is not null").groupBy("chunk_hash").agg(F.max("chunk_length").alias("length"))
    return layout.chunk_layout(m, lengths)


@query(f"SELECT chunk_hash, {_big('compressed_length')} AS compressed_length, row_number() OVER (ORDER BY chunk_hash) - 1 AS position, {_big('coalesce(sum(compressed_length) OVER (ORDER BY chunk_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS layout_offset FROM chunkindex")
def hash_order_layout(spark, d):
    return layout.hash_layout(table(spark, d, "chunkindex"), length="compressed_length")


@query(f"WITH {_M} SELECT file_id, CAST(arg_max(chunk_offset + chunk_length, {{'a': chunk_offset, 'b': chunk_length}}) AS BIGINT) AS size_last, {_big('sum(chunk_length)')} AS size_sum, count(*) AS chunks FROM m GROUP BY file_id")
def file_sizes(spark, d):
    return layout.file_sizes(_manifest(spark, d))


@query(f"SELECT game_id, file_id, {_big('n')} AS n, {_big('coalesce(sum(n) OVER (PARTITION BY game_id ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS base FROM (SELECT game_id, file_id, coalesce(octet_length(file_data), 0) AS n FROM filedata WHERE game_id IS NOT NULL)")
def multipart_boundaries(spark, d):
    parts = table(spark, d, "filedata").filter("game_id is not null").select("game_id", "file_id", F.coalesce(F.octet_length("file_data"), F.lit(0)).cast("long").alias("n"))
    return layout.part_bases(parts, "game_id", "file_id", "n")


@query(f"WITH u AS (SELECT chunk_hash, max(chunk_length) AS length FROM manifest WHERE chunk_hash IS NOT NULL GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY chunk_hash) - 1 AS i FROM u), k AS (SELECT chunk_hash, length FROM s WHERE i % greatest(1, ceil((SELECT sum(length) FROM u) / 65536.0)) = 0), c AS (SELECT *, sum(length) OVER (ORDER BY chunk_hash) AS upto FROM k) SELECT chunk_hash, {_big('length')} AS length FROM c WHERE upto <= 65536")
def sample_stride(spark, d):
    u = table(spark, d, "manifest").filter("chunk_hash is not null").groupBy("chunk_hash").agg(F.max("chunk_length").cast("long").alias("length"))
    return layout.strided_sample(u, 65536)


# Joins

@query("SELECT file_id, chunk_no, m.chunk_hash, i.chunk_offset AS stored_at, CAST(compressed_length AS BIGINT) AS compressed_length FROM manifest m JOIN chunkindex i USING (chunk_hash)")
def manifest_index_join(spark, d):
    i = table(spark, d, "chunkindex").select("chunk_hash", F.col("chunk_offset").alias("stored_at"), F.col("compressed_length").cast("long").alias("compressed_length"))
    return joins.checked_join(table(spark, d, "manifest").join(i.select("chunk_hash"), "chunk_hash", "left_semi"), i, "chunk_hash", "index").select("file_id", "chunk_no", "chunk_hash", "stored_at", "compressed_length")


@query("SELECT DISTINCT chunk_hash FROM manifest WHERE chunk_hash IS NOT NULL AND chunk_hash NOT IN (SELECT chunk_hash FROM chunkindex)")
def missing_chunks(spark, d):
    return joins.missing(table(spark, d, "manifest"), table(spark, d, "chunkindex"), "chunk_hash")


@query(f"SELECT DISTINCT k AS chunk_hash FROM (SELECT {_KEY} AS k FROM chunkmessage) WHERE k IS NOT NULL AND k NOT IN (SELECT chunk_hash FROM manifest WHERE chunk_hash IS NOT NULL)")
def orphan_chunks(spark, d):
    return joins.missing(_keyed(spark, d), table(spark, d, "manifest"), "chunk_hash")


@query(f"SELECT chunk_hash, CAST(i.chunk_offset AS BIGINT) AS chunk_offset FROM chunkindex i WHERE chunk_hash = (SELECT min(chunk_hash) FROM chunkindex)")
def point_lookup(spark, d):
    i = table(spark, d, "chunkindex")
    return i.filter(F.col("chunk_hash") == i.agg(F.min("chunk_hash")).scalar()).select("chunk_hash", F.col("chunk_offset").cast("long").alias("chunk_offset"))


_COLLECT = r"""e AS (SELECT playlist_id, regexp_replace(line_text, '^[\s\x{FEFF}]+|\s+$', '', 'g') AS t FROM playlist), b AS (SELECT playlist_id, regexp_extract(t, '([^/\\]*)$', 1) AS n FROM e WHERE t <> '' AND NOT starts_with(t, '#')),
p AS (SELECT playlist_id, CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN regexp_extract(n, '^(.+)\.[^.]*$', 1) ELSE n END AS title FROM b), c AS (SELECT playlist_id, (dense_rank() OVER (ORDER BY playlist_id) - 1) % 256 AS cid FROM p), l AS (SELECT title, CAST(arg_max(cid, c.playlist_id) AS INTEGER) AS collection_id FROM p JOIN (SELECT DISTINCT * FROM c) c USING (playlist_id) GROUP BY title)"""


def _collections(spark, d):
    return cue.collections(cue.playlist_entries(table(spark, d, "playlist")))


@query(f"WITH {_COLLECT} SELECT * FROM l")
def playlist_collections(spark, d):
    return _collections(spark, d)


@query(rf"WITH {_COLLECT}, t AS (SELECT archive_id, toc_idx, filename, regexp_extract(filename, '([^/\\]*)$', 1) AS n FROM toc WHERE filename IS NOT NULL), s AS (SELECT *, CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN regexp_extract(n, '^(.+)\.[^.]*$', 1) ELSE n END AS title FROM t) SELECT archive_id, toc_idx, title, coalesce(collection_id, 255) AS collection_id FROM s LEFT JOIN l USING (title)")
def collection_map(spark, d):
    t = table(spark, d, "toc").filter("filename is not null").select("archive_id", "toc_idx", scalars.stem(scalars.base_name(F.col("filename"))).alias("title"))
    return joins.with_default(t, _collections(spark, d), "title", "collection_id", F.lit(255)).select("archive_id", "toc_idx", "title", "collection_id")


# Seeks

_BLOCK_MANIFEST = "b AS (SELECT file_id, n, 1024 * i AS o, least(1024, n - 1024 * i) AS l FROM (SELECT file_id, octet_length(file_data) AS n, unnest(range((octet_length(file_data) + 1023) // 1024)) AS i FROM filedata WHERE octet_length(file_data) > 0))"
_REQUESTS = "q AS (SELECT file_id, k AS request_no, CASE k WHEN 0 THEN n // 3 WHEN 1 THEN 1024 WHEN 2 THEN 100 ELSE 0 END AS s, CASE k WHEN 0 THEN 1500 WHEN 1 THEN 1024 WHEN 2 THEN 0 ELSE n END AS z, n FROM (SELECT file_id, octet_length(file_data) AS n FROM filedata WHERE octet_length(file_data) > 0), range(4) r(k))"


def _seek_tables(spark, d):
    sizes = _files(spark, d).filter("octet_length(file_data) > 0").select("file_id", F.octet_length("file_data").cast("long").alias("size"))
    blocks = sizes.select("file_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(size - 1) div 1024"))).alias("i")).select("file_id", (F.col("i") * 1024).alias("chunk_offset"), F.least(F.lit(1024), F.col("size") - F.col("i") * 1024).alias("chunk_length"))
    some = F.array(*[F.struct(F.lit(i).cast("long").alias("request_no"), s.cast("long").alias("seek_offset"), z.cast("long").alias("seek_length")) for i, (s, z) in enumerate(((F.expr("size div 3"), F.lit(1500)), (F.lit(1024), F.lit(1024)), (F.lit(100), F.lit(0)), (F.lit(0), F.col("size"))))])
    return sizes, blocks, sizes.select("file_id", F.explode(some).alias("r")).select("file_id", "r.*")


@query(f"WITH {_BLOCK_MANIFEST}, {_REQUESTS} SELECT q.file_id, request_no, {_big('o')} AS chunk_offset, {_big('greatest(s - o, 0)')} AS slice_start, {_big('least(s + z - o, l)')} AS slice_end FROM q JOIN b ON q.file_id = b.file_id AND o < s + z AND o + l > s")
def seek_range(spark, d):
    _, blocks, requests = _seek_tables(spark, d)
    return seek.seek(blocks, requests).select("file_id", "request_no", "chunk_offset", "slice_start", "slice_end")


@query(f"WITH {_REQUESTS} SELECT file_id, request_no, {_big('s')} AS seek_offset, {_big('z')} AS seek_length, {_big('n')} AS size FROM q WHERE s + z > n")
def seek_out_of_bounds(spark, d):
    sizes, _, requests = _seek_tables(spark, d)
    return seek.out_of_bounds(requests, sizes).select("file_id", "request_no", "seek_offset", "seek_length", "size")


# Runs over ordered rows

def _events(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


_E = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
_RLE = f"{_E}, r0 AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = event_type THEN 0 ELSE 1 END AS nw FROM e), r1 AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS rn FROM r0), rle AS (SELECT user_id, {_big('rn')} AS run_no, min(pos) AS run_start, count(*) AS run_length, any_value(event_type) AS event_type FROM r1 GROUP BY user_id, rn)"


@query(f"WITH {_RLE} SELECT * FROM rle")
def rle_encode(spark, d):
    return runs.runs(_events(spark, d), ["user_id"], "pos", "event_type")


@query(f"WITH {_E} SELECT user_id, pos, event_type FROM e")
def rle_decode_roundtrip(spark, d):
    return runs.expand_runs(runs.runs(_events(spark, d), ["user_id"], "pos", "event_type"), ["user_id"], "event_type")


@query(f"WITH {_RLE} SELECT user_id, max(run_length) AS longest FROM rle GROUP BY user_id")
def rle_longest_run(spark, d):
    return runs.runs(_events(spark, d), ["user_id"], "pos", "event_type").groupBy("user_id").agg(F.max("run_length").alias("longest"))


@query(f"WITH {_M}, a AS (SELECT *, CASE WHEN chunk_hash IS NOT DISTINCT FROM lag(chunk_hash) OVER w AND row_number() OVER w > 1 AND lag(chunk_no) OVER w = chunk_no - 1 THEN 0 ELSE 1 END AS nw FROM m WINDOW w AS (PARTITION BY file_id ORDER BY chunk_no)), b AS (SELECT *, sum(nw) OVER (PARTITION BY file_id ORDER BY chunk_no) - 1 AS rn FROM a) SELECT file_id, {_big('rn')} AS run_no, min(chunk_no) AS run_start, count(*) AS run_length, any_value(chunk_hash) AS chunk_hash FROM b GROUP BY file_id, rn")
def subheader_runs(spark, d):
    return runs.runs(_manifest(spark, d), ["file_id"], "chunk_no", "chunk_hash", contiguous=True)


@query(f"WITH {_E}, s AS (SELECT *, CASE event_type WHEN 'view' THEN 2048 WHEN 'click' THEN 2324 ELSE 2352 END AS n FROM e) SELECT user_id, pos, {_big('coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS stream_offset FROM s")
def stream_offsets(spark, d):
    kind = F.when(F.col("event_type") == "view", "Mode1").when(F.col("event_type") == "click", "Mode2Form2").otherwise("Audio")
    return runs.stream_offsets(_events(spark, d), ["user_id"], "pos", disc.data_size(kind)).select("user_id", "pos", "stream_offset")


@query(f"WITH {_E}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS was FROM e) SELECT user_id, pos, event_type FROM l WHERE pos = 0 OR event_type IS DISTINCT FROM was")
def lba_changepoints(spark, d):
    return runs.change_points(_events(spark, d), ["user_id"], "pos", "event_type")


@query(f"WITH {_E}, c AS (SELECT user_id, pos, event_id AS last_purchase FROM e WHERE event_type = 'purchase') SELECT e.user_id, e.pos, coalesce(c.last_purchase, 0) AS last_purchase FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.pos >= c.pos")
def lba_asof(spark, d):
    e = _events(spark, d)
    c = e.filter("event_type = 'purchase'").select("user_id", F.col("pos").alias("since"), F.col("event_id").alias("last_purchase"))
    return joins.asof(e.select("user_id", "pos"), c, ["user_id"], "pos", "since", "last_purchase", F.lit(0).cast("long"))


_BLOCKS16 = f"{_RLE}, bl AS (SELECT user_id, run_no, CAST(i AS BIGINT) AS block_no, run_start + 16 * i AS block_start, least(16, run_length - 16 * i) AS block_count FROM (SELECT *, unnest(range((run_length + 15) // 16)) AS i FROM rle))"


def _blocks16(spark, d):
    r = runs.runs(_events(spark, d), ["user_id"], "pos", "event_type")
    return chunking.run_blocks(r, "run_start", "run_length").select("user_id", "run_no", "block_no", "block_start", "block_count")


@query(f"WITH {_BLOCKS16} SELECT user_id, run_no, block_no, {_big('block_start')} AS block_start, {_big('block_count')} AS block_count FROM bl")
def audio_block_map(spark, d):
    return _blocks16(spark, d)


@query(f"WITH {_BLOCKS16} SELECT e.user_id, e.pos, {_big('block_start')} AS block_start FROM e JOIN bl ON e.user_id = bl.user_id AND pos >= block_start AND pos < block_start + block_count")
def sector_to_block(spark, d):
    e = _events(spark, d).select("user_id", "pos", (F.col("pos") + 1).alias("pos_end"))
    b = _blocks16(spark, d).select("user_id", "block_start", (F.col("block_start") + F.col("block_count")).alias("block_end"))
    return joins.interval_join(e, b, ["user_id"], "pos", "pos_end", "block_start", "block_end", 16).select("user_id", "pos", "block_start")


@query(f"WITH f AS (SELECT props, min({{'t': ts, 'e': event_id}}) AS a, octet_length(encode(props)) AS n FROM events WHERE props IS NOT NULL GROUP BY props) SELECT props, row_number() OVER (ORDER BY a) - 1 AS id, {_big('coalesce(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS value_offset, {_big('n')} AS value_length FROM f")
def exception_registry(spark, d):
    return runs.registry(table(spark, d, "events"), "props", ["ts", "event_id"], F.octet_length("props"))


@query(f"WITH {_RLE} SELECT user_id, run_start, coalesce(lead(run_start) OVER (PARTITION BY user_id ORDER BY run_start), (SELECT max(pos) + 1 FROM e WHERE e.user_id = rle.user_id)) AS next_start FROM rle")
def track_intervals(spark, d):
    r = runs.runs(_events(spark, d), ["user_id"], "pos", "event_type")
    return runs.next_start(r, ["user_id"], "run_start", F.col("run_start") + F.col("run_length")).select("user_id", "run_start", "next_start")


# Positions

@query("SELECT DISTINCT l_partkey AS frames, printf('%02d:%02d:%02d', (l_partkey // 4500) % 256, (l_partkey // 75) % 60, l_partkey % 75) AS msf, CAST(l_partkey AS INTEGER) AS back FROM lineitem")
def msf_roundtrip(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_partkey").alias("frames")).distinct()
    text = scalars.msf_text(scalars.frames_to_msf(F.col("frames")))
    return keys.select("frames", text.alias("msf"), scalars.parse_msf(text).alias("back"))


@query("SELECT DISTINCT CAST(l_linenumber * 10 + l_suppkey % 10 AS INTEGER) AS n, CAST(((l_linenumber * 10 + l_suppkey % 10) // 10) * 16 + (l_linenumber * 10 + l_suppkey % 10) % 10 AS INTEGER) AS bcd, CAST(l_linenumber * 10 + l_suppkey % 10 AS INTEGER) AS back FROM lineitem")
def bcd_roundtrip(spark, d):
    n = table(spark, d, "lineitem").select((F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).cast("int").alias("n")).distinct()
    return n.select("n", scalars.to_bcd(F.col("n")).alias("bcd"), scalars.from_bcd(scalars.to_bcd(F.col("n"))).alias("back"))


# CUE sheets: one made for each game of its image files

_IMAGES = "i AS (SELECT game_id, file_id, octet_length(file_data) AS n, row_number() OVER (PARTITION BY game_id ORDER BY file_id) AS k FROM filedata WHERE game_id IS NOT NULL AND octet_length(file_data) > 0 AND octet_length(file_data) % 2352 = 0)"


def _images(spark, d):
    w = Window.partitionBy("game_id").orderBy("file_id")
    return table(spark, d, "filedata").filter("game_id is not null and octet_length(file_data) > 0 and octet_length(file_data) % 2352 = 0").select("game_id", "file_id", "file_data", F.octet_length("file_data").cast("long").alias("size"), F.row_number().over(w).alias("k"))


def _sheets(spark, d):
    line = F.concat(
        F.lit('FILE "img_'), F.col("file_id"), F.lit('.bin" BINARY\n  TRACK '), F.format_string("%02d", F.col("k")), F.when(F.col("k") % 2 == 1, " mode1/2352").otherwise(" AUDIO"), F.lit("\n"),
        F.when(F.col("k") > 1, "    INDEX 00 00:00:00\n    INDEX 01 00:02:00\n").otherwise("    INDEX 01 00:00:00\n"), F.lit("REM end\n"),
    )
    parts = _images(spark, d).groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))).alias("p"))
    return parts.select(F.col("game_id").alias("sheet"), F.array_join(F.transform("p", lambda x: x["l"]), "").alias("text"))


@query(f"WITH {_IMAGES} SELECT game_id AS sheet, CAST(k AS INTEGER) AS file_no, 'img_' || file_id || '.bin' AS file_name, CAST(k AS INTEGER) AS track_no, CASE WHEN k % 2 = 1 THEN 'MODE1/2352' ELSE 'AUDIO' END AS track_mode, j AS index_no, CASE WHEN k > 1 AND j = 1 THEN 150 ELSE 0 END AS frames FROM i, (VALUES (0), (1)) v(j) WHERE k > 1 OR j = 1")
def cue_parse(spark, d):
    return cue.parse_cue(_sheets(spark, d))


@query(f"WITH {_IMAGES}, b AS (SELECT *, {_big('coalesce(sum(n // 2352) OVER (PARTITION BY game_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS base FROM i) SELECT game_id AS sheet, CAST(k AS INTEGER) AS track_no, base + CASE WHEN k > 1 THEN 150 ELSE 0 END AS content_start, base AS track_start, lead(base) OVER (PARTITION BY game_id ORDER BY k) AS next_start FROM b")
def cue_track_starts(spark, d):
    sizes = _images(spark, d).select(F.col("game_id").alias("sheet"), F.format_string("img_%d.bin", F.col("file_id")).alias("file_name"), "size")
    return cue.track_starts(cue.normalised(cue.parse_cue(_sheets(spark, d)), sizes), at="position").select("sheet", "track_no", "content_start", "track_start", "next_start")


_KIND = "CASE event_type WHEN 'view' THEN 'MODE1/2352' WHEN 'click' THEN 'MODE2/2352' ELSE 'AUDIO' END"


@query(f"""WITH {_RLE}, a AS (SELECT user_id, run_no, run_start, run_length, {_KIND} AS mode, event_type = 'purchase' AS pre FROM rle),
n AS (SELECT *, CASE WHEN pre OR mode IS DISTINCT FROM lag(mode) OVER (PARTITION BY user_id ORDER BY run_no) THEN 1 ELSE 0 END AS nw FROM a), t AS (SELECT *, {_big('sum(nw) OVER (PARTITION BY user_id ORDER BY run_no)')} AS track_no FROM n)
SELECT user_id, CAST(track_no AS INTEGER) AS track_no, arg_min(mode, run_no) AS mode, {_big('min(CASE WHEN pre THEN run_start END)')} AS index00, {_big('coalesce(min(CASE WHEN NOT pre THEN run_start END), max(run_start + run_length))')} AS index01 FROM t GROUP BY user_id, track_no""")
def cue_generate(spark, d):
    kind = F.when(F.col("event_type") == "view", "Mode1").when(F.col("event_type") == "click", "Mode2Form1").when(F.col("event_type") == "purchase", "PregapAudio").otherwise("Audio")
    return cue.cue_tracks(runs.runs(_events(spark, d), ["user_id"], "pos", "event_type"), "user_id", kind)


_AT = "printf('%02d:%02d:%02d', ({0} // 4500) % 256, ({0} // 75) % 60, {0} % 75)"


@query(f"""SELECT user_id, 'FILE "user_' || user_id || '.bin" BINARY' || chr(10) || string_agg('  TRACK ' || printf('%02d ', track_no) || mode || chr(10)
|| CASE WHEN index00 IS NULL THEN '' ELSE '    INDEX 00 ' || {_AT.format("index00")} || chr(10) END || '    INDEX 01 ' || {_AT.format("index01")} || chr(10), '' ORDER BY track_no) AS cue FROM ({SQL["cue_generate"]}) GROUP BY user_id""")
def cue_sheets(spark, d):
    t = cue_generate(spark, d)
    return cue.cue_text(t, "user_id", F.concat(F.lit("user_"), F.col("user_id"), F.lit(".bin")))


# Content-defined chunks, digests, codecs

def _chunks(spark, d, **how):
    return chunking.content_chunks(_files(spark, d), "file_data", ["file_id"], **how)


@query("SELECT file_id, CAST(octet_length(file_data) AS BIGINT) AS size, true AS sizes_ok, true AS gapless FROM filedata WHERE octet_length(file_data) > 0")
def cdc_sizes_ok(spark, d):
    w = Window.partitionBy("file_id").orderBy("chunk_no")
    c = _chunks(spark, d, window=1024).select("file_id", "chunk_no", "chunk_offset", F.col("chunk_length").cast("long").alias("n"))
    c = c.withColumn("last", F.lead("chunk_no").over(w).isNull()).withColumn("from", F.coalesce(F.lag(F.col("chunk_offset") + F.col("n")).over(w), F.lit(0)))
    return c.groupBy("file_id").agg(F.sum("n").alias("size"), F.min((F.col("n") <= 4096) & ((F.col("n") >= 256) | F.col("last"))).alias("sizes_ok"), F.min(F.col("from") == F.col("chunk_offset")).alias("gapless"))


@query("SELECT file_id, md5(file_data) AS md5 FROM filedata WHERE octet_length(file_data) > 0")
def cdc_reassembly(spark, d):
    chunks = stage(_chunks(spark, d), "cdc")
    whole = verify.reassembled(verify.with_chunks(chunks.drop("chunk_data"), dedup.store(chunks)))
    return whole.select("file_id", F.md5("content").alias("md5"))


@query("SELECT file_id, CAST(coalesce(octet_length(file_data), 0) AS BIGINT) AS size, true AS ok FROM filedata")
def sha512_verify(spark, d):
    chunks = stage(_chunks(spark, d, level=1, bits=128), "cdc")
    rows = verify.with_chunks(chunks.drop("chunk_data"), dedup.store(chunks))
    return verify.verified(rows, _files(spark, d).withColumnRenamed("file_data", "content"))


@query("SELECT count(*) AS contents, count(*) AS hashes FROM (SELECT DISTINCT file_data FROM filedata WHERE file_data IS NOT NULL)")
def xxh3_collision_free(spark, d):
    f = _files(spark, d).filter("file_data is not null").select(chunk_hash(F.col("file_data")).alias("h"), F.sha2("file_data", 256).alias("s"))
    return f.agg(F.countDistinct("s").alias("contents"), F.countDistinct("h").alias("hashes"))


@query()
def file_digests(spark, d):
    return _files(spark, d).select("file_id", both_digests(F.col("file_data")).alias("g")).select("file_id", "g.sha512", "g.xxh3")


@query("SELECT file_id, md5(file_data) AS md5, true AS smaller FROM filedata WHERE octet_length(file_data) > 512")
def zstd_roundtrip(spark, d):
    f = _files(spark, d).filter("octet_length(file_data) > 512").select("file_id", "file_data")
    packed = codec.with_codec(f, "file_data", "z", "compress", b"", 7).select("file_id", F.octet_length("file_data").alias("n"), "z")
    back = codec.with_codec(packed, "z", "data", "decompress")
    return back.select("file_id", F.md5("data").alias("md5"), (F.octet_length("z") <= F.col("n") + 32).alias("smaller"))


@query(f"SELECT {_big('sum(n)')} AS bytes, {_big('(SELECT sum(octet_length(file_data)) FROM (SELECT DISTINCT file_data FROM filedata))')} AS exact_unique_bytes, true AS chunks_at_most FROM (SELECT octet_length(file_data) AS n FROM filedata)")
def cdc_dedup_vs_exact(spark, d):
    n = F.octet_length("file_data").cast("long")
    exact = _files(spark, d).filter("file_data is not null").groupBy(F.sha2("file_data", 256)).agg(F.count(F.lit(1)).alias("k"), F.max(n).alias("n")).agg(F.sum(F.col("k") * F.col("n")).alias("bytes"), F.sum("n").alias("exact_unique_bytes"))
    chunks = dedup.unique_bytes(_chunks(spark, d), F.col("chunk_length").cast("long")).select("unique_bytes")
    return exact.withColumn("chunks_at_most", F.lit(chunks.scalar()) <= F.col("exact_unique_bytes"))


@query(f"SELECT file_id % 8 AS blob, {_big('sum(octet_length(file_data))')} AS bytes, true AS same FROM filedata WHERE octet_length(file_data) > 0 GROUP BY 1")
def cdc_file_ranges(spark, d):
    """All files put into eight blobs on disk, chunked by ranges of 64 KiB, against the same blobs chunked in one piece."""
    folder = f"{shared_dir(spark)}/stage-blobs-{uuid.uuid4().hex}"
    blobs = stage(concatenated(_files(spark, d).filter("octet_length(file_data) > 0").withColumn("blob", F.col("file_id") % 8), ["blob"], "file_id", "file_data", "data"), "blobs")
    sources.write_files(blobs.select(F.concat(F.lit("blob-"), F.col("blob")).alias("name"), "data"), folder).count()
    a = chunking.chunks_of_files(spark, [folder], range_bytes=1 << 16).select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("blob"), "chunk_no", "chunk_offset", "chunk_length", "chunk_hash", F.lit(1).alias("times"))
    b = chunking.content_chunks(blobs, "data", ["blob"]).select("blob", "chunk_no", "chunk_offset", "chunk_length", "chunk_hash", F.lit(2).alias("times"))
    each = a.unionByName(b).groupBy("blob", "chunk_no", "chunk_offset", "chunk_length", "chunk_hash").agg(F.sum("times").alias("times"))
    return each.groupBy("blob").agg(F.sum(F.when(F.col("times").bitwiseAND(F.lit(1)) == 1, F.col("chunk_length"))).cast("long").alias("bytes"), F.min(F.col("times") == 3).alias("same"))


@query(f"SELECT game_id, file_id, {_big('mid - base')} AS place FROM (SELECT *, sum(n) OVER w - n AS base, sum(n) OVER (PARTITION BY game_id) // 2 AS mid, sum(n) OVER w AS upto FROM (SELECT game_id, file_id, coalesce(octet_length(file_data), 0) AS n FROM filedata WHERE game_id IS NOT NULL) WINDOW w AS (PARTITION BY game_id ORDER BY file_id)) WHERE base <= mid AND mid < upto")
def multipart_locate(spark, d):
    """The part, and the byte in it, that holds the middle byte of each game's files put one after the other."""
    parts = layout.part_bases(table(spark, d, "filedata").filter("game_id is not null").select("game_id", "file_id", F.coalesce(F.octet_length("file_data"), F.lit(0)).cast("long").alias("n")), "game_id", "file_id", "n").filter("n > 0")
    at = parts.groupBy("game_id").agg(F.expr("sum(n) div 2").alias("at"))
    hit = joins.asof(at, parts.select("game_id", "base", F.struct("base", "file_id").alias("part")), ["game_id"], "at", "base", "part")
    return hit.select("game_id", "part.file_id", (F.col("at") - F.col("part.base")).alias("place"))


@query("SELECT 'plain' AS codec, true AS smaller UNION ALL SELECT 'dictionary', true")
def zstd_gain_positive(spark, d):
    raw = dedup.unique_bytes(_chunks(spark, d), F.col("chunk_length").cast("long")).select("unique_bytes").scalar()
    return zstd_gain(spark, d).select("codec", (F.col("compressed_bytes") < F.lit(raw)).alias("smaller"))


@query()
def zstd_gain(spark, d):
    chunks = stage(dedup.store(_chunks(spark, d)).select("chunk_hash", "chunk_data"), "store")
    trained = tuning.dictionary(chunks, 16384)
    rows = [(name, len(x), codec.trial_size(chunks, "chunk_data", x, 7)) for name, x in (("plain", b""), ("dictionary", trained))]
    return spark.createDataFrame(rows, "codec string, dictionary_bytes long, compressed_bytes long")


@query("SELECT vec_id, true AS ok FROM embeddings")
def audio_roundtrip(spark, d):
    pcm = table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex((F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 16000 + 32768).cast("int")), 4, "0")), "")).alias("pcm"))
    packed = codec.with_codec(pcm, "pcm", "z", "audio")
    return codec.with_codec(packed, "z", "back", "unaudio").select("vec_id", (F.col("back") == F.col("pcm")).alias("ok"))


@query()
def autotune_window(spark, d):
    f = stage(_files(spark, d).select("file_id", "file_data"), "input")
    largest = f.agg(F.max(F.octet_length("file_data"))).first()[0] or 0
    make = lambda w: stage(dedup.store(chunking.content_chunks(f, "file_data", ["file_id"], w)), "trial")
    t = tuning.tune_window(make, largest)
    return spark.createDataFrame([(x.parameter, x.size, x is tuning.best(t)) for x in t], "window long, size long, chosen boolean")


@query()
def autotune_dict(spark, d):
    chunks = stage(dedup.store(_chunks(spark, d)), "store")
    t = tuning.tune_dictionary(chunks)
    return spark.createDataFrame([(x.parameter, x.size, x is tuning.best(t)) for x in t], "dictionary long, size long, chosen boolean")


# Archives

def _archive(spark, d) -> str:
    path = f"{shared_dir(spark)}/stage-archive-{uuid.uuid4().hex}.cla"
    compress.compress(_files(spark, d).withColumnRenamed("file_data", "content"), path, Settings(level=7))
    return path


@query("SELECT row_number() OVER (ORDER BY coalesce(file_name, ''), file_id) AS index, coalesce(file_name, '') AS filename, CAST(coalesce(octet_length(file_data), 0) AS BIGINT) AS size_bytes FROM filedata")
def archive_toc(spark, d):
    return extract.listing(spark, _archive(spark, d)).select("index", "filename", "size_bytes")


@query("SELECT row_number() OVER (ORDER BY coalesce(file_name, ''), file_id) AS toc_no, coalesce(file_name, '') AS filename, true AS ok FROM filedata")
def archive_verify(spark, d):
    return extract.verify(spark, _archive(spark, d))


@query("WITH t AS (SELECT row_number() OVER (ORDER BY coalesce(file_name, ''), file_id) AS toc_no, file_data, octet_length(file_data) AS n FROM filedata) SELECT toc_no AS request_id, md5(unhex(substr(hex(file_data), 2 * (n // 4) + 1, 2 * (n // 2)))) AS md5 FROM t WHERE n >= 8")
def archive_seek(spark, d):
    path = _archive(spark, d)
    toc = extract.selected(spark, path, None).filter("uncompressed_size >= 8")
    q = toc.select(F.col("toc_no").alias("request_id"), "toc_no", F.expr("uncompressed_size div 4").alias("seek_offset"), F.expr("uncompressed_size div 2").alias("seek_length"))
    return extract.read_ranges(spark, path, q).select("request_id", F.md5("bytes").alias("md5"))


# Discs: every file of whole sectors is an image

def _discs(spark, d):
    return table(spark, d, "filedata").filter("octet_length(file_data) > 0 and octet_length(file_data) % 2352 = 0").select(F.col("file_id").alias("disc"), F.col("file_data").alias("image"))


_SECTORS = "s AS (SELECT file_id AS disc, CAST(i AS BIGINT) AS sector_idx, substr(hex(file_data), 4704 * i + 1, 4704) AS h FROM (SELECT file_id, file_data, unnest(range(octet_length(file_data) // 2352)) AS i FROM filedata WHERE octet_length(file_data) > 0 AND octet_length(file_data) % 2352 = 0))"
_MODE = "CASE WHEN h = repeat('00', 2352) THEN 'zero' WHEN substr(h, 1, 24) <> '00FFFFFFFFFFFFFFFFFFFF00' THEN 'audio' WHEN substr(h, 31, 2) = '01' THEN 'mode1' WHEN ('0x' || substr(h, 37, 2))::INT & 32 <> 0 THEN 'form2' ELSE 'form1' END"


@query(f"WITH {_SECTORS} SELECT disc, sector_idx, {_MODE} AS family FROM s")
def sector_classify(spark, d):
    k = F.col("kind")
    family = F.when(k.startswith("Zeroed"), "zero").when(k == "Audio", "audio").when(k.startswith("Mode1"), "mode1").when(k.startswith("Mode2Form2"), "form2").otherwise("form1")
    return optical.sector_map(_discs(spark, d)).select("disc", "sector_idx", family.alias("family"))


@query()
def sector_kinds(spark, d):
    return optical.sector_map(_discs(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("sectors"), F.countDistinct("disc").alias("discs"))


@query(f"WITH {_SECTORS} SELECT disc, sector_idx, md5(unhex(h)) AS md5 FROM s")
def disc_roundtrip(spark, d):
    m = stage(optical.sector_map(_discs(spark, d)), "map")
    return optical.rebuilt(optical.shredded(m), optical.addresses(m)).select("disc", "sector_idx", F.md5("sector").alias("md5"))


@query("SELECT file_id AS disc, CAST(octet_length(file_data) // 2352 AS BIGINT) AS sectors, true AS ok FROM filedata WHERE octet_length(file_data) > 0 AND octet_length(file_data) % 2352 = 0")
def disc_verify(spark, d):
    images = _discs(spark, d)
    m = stage(optical.sector_map(images), "map")
    got = optical.disc_digests(optical.rebuilt(optical.shredded(m), optical.addresses(m)))
    want = images.select("disc", both_digests(F.col("image")).alias("w"))
    return got.join(want, "disc").select("disc", "sectors", ((F.col("sha512") == F.col("w.sha512")) & (F.col("xxh3") == F.col("w.xxh3"))).alias("ok"))


@query(f"WITH {_SECTORS}, k AS (SELECT *, {_MODE} AS f FROM s), a AS (SELECT *, CASE WHEN lag(f) OVER w = f THEN 0 ELSE 1 END AS nw FROM k WINDOW w AS (PARTITION BY disc ORDER BY sector_idx)), r AS (SELECT *, sum(nw) OVER (PARTITION BY disc ORDER BY sector_idx) AS rn FROM a), q AS (SELECT disc, rn, min(sector_idx) AS st, count(*) AS n FROM r WHERE f = 'audio' GROUP BY 1, 2) SELECT disc, st + 16 * i AS block_start, least(16, n - 16 * i) AS block_count FROM (SELECT *, unnest(range((n + 15) // 16)) AS i FROM q)")
def disc_audio_blocks(spark, d):
    return optical.audio_blocks(optical.sector_map(_discs(spark, d))).select("disc", "block_start", "block_count")


@query(f"WITH {_SECTORS} SELECT disc, {_big('count(*) * 2352')} AS image_bytes FROM s GROUP BY disc")
def disc_sizes(spark, d):
    return optical.disc_sizes(optical.kind_runs(optical.sector_map(_discs(spark, d))))


_EXTRA = "CASE WHEN f IN ('mode1', 'zero') THEN substr(h, 4137, 16) WHEN f <> 'audio' THEN substr(h, 33, 16) END"
_CRC = "list_reduce(list_prepend(0::UBIGINT, list_transform(range(2064), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, [" + ", ".join(f"{x}::UBIGINT" for x in disc.edc_table().tolist()) + "][(xor(c, b) & 255)::INT + 1]))"


@query(f"WITH {_SECTORS}, k AS (SELECT *, {_MODE} AS f FROM s) SELECT disc, sector_idx, md5(unhex(CASE f WHEN 'mode1' THEN substr(h, 33, 4096) WHEN 'form1' THEN substr(h, 49, 4096) WHEN 'form2' THEN substr(h, 49, 4648) ELSE h END)) AS md5 FROM k")
def disc_user_data(spark, d):
    return optical.sector_map(_discs(spark, d)).select("disc", "sector_idx", F.md5(disc.user_data(F.col("sector"), F.col("kind"))).alias("md5"))


@query(f"WITH {_SECTORS}, k AS (SELECT disc, {_MODE} AS f FROM s) SELECT disc, {_big('sum(CASE f WHEN ' + chr(39) + 'mode1' + chr(39) + ' THEN 2048 WHEN ' + chr(39) + 'form1' + chr(39) + ' THEN 2048 WHEN ' + chr(39) + 'form2' + chr(39) + ' THEN 2324 ELSE 2352 END)')} AS bytes, true AS gapless FROM k WHERE f <> 'audio' GROUP BY disc")
def disc_user_bytes(spark, d):
    """The data chunks of each disc: their bytes, and whether those of each run follow each other."""
    c = disc_user_chunks(spark, d)
    w = Window.partitionBy("disc", "run_no").orderBy("chunk_no")
    c = c.withColumn("ok", F.coalesce(F.lag(F.col("chunk_offset") + F.col("chunk_length")).over(w), F.lit(0)) == F.col("chunk_offset"))
    return c.groupBy("disc").agg(F.sum("chunk_length").cast("long").alias("bytes"), F.min("ok").alias("gapless"))


@query()
def disc_user_chunks(spark, d):
    return optical.user_chunks(stage(optical.sector_map(_discs(spark, d)), "map")).select("disc", "run_no", "chunk_no", "chunk_offset", "chunk_length", "chunk_hash")


@query(f"WITH {_SECTORS}, k AS (SELECT *, {_MODE} AS f FROM s), x AS (SELECT disc, sector_idx, {_EXTRA} AS extra FROM k), a AS (SELECT *, CASE WHEN lag(extra) OVER w = extra AND lag(sector_idx) OVER w = sector_idx - 1 THEN 0 ELSE 1 END AS nw FROM x WHERE extra IS NOT NULL WINDOW w AS (PARTITION BY disc ORDER BY sector_idx)), r AS (SELECT *, sum(nw) OVER (PARTITION BY disc ORDER BY sector_idx) - 1 AS run_no FROM a) SELECT disc, {_big('run_no')} AS run_no, min(sector_idx) AS run_start, count(*) AS run_length, any_value(extra) AS extra FROM r GROUP BY disc, run_no")
def disc_subheaders(spark, d):
    return optical.subheaders(optical.sector_map(_discs(spark, d)))


def _nibbles(i: int) -> str:
    return f"(('0x' || substr(h, {i}, 1))::INT * 10 + ('0x' || substr(h, {i + 1}, 1))::INT)"


@query(f"WITH {_SECTORS}, k AS (SELECT *, {_MODE} AS f FROM s), a AS (SELECT disc, sector_idx, {_big(f'({_nibbles(25)} * 60 + {_nibbles(27)}) * 75 + {_nibbles(29)}')} - sector_idx AS lba_offset FROM k WHERE f NOT IN ('audio', 'zero')), c AS (SELECT *, lag(lba_offset) OVER (PARTITION BY disc ORDER BY sector_idx) AS was FROM a WHERE lba_offset >= 0) SELECT disc, sector_idx AS from_sector, lba_offset FROM c WHERE was IS DISTINCT FROM lba_offset")
def disc_addresses(spark, d):
    return optical.addresses(optical.sector_map(_discs(spark, d)))


@query()
def disc_exceptions(spark, d):
    e = optical.exceptions(optical.sector_map(_discs(spark, d))).withColumn("saved", F.hex("saved"))
    return e.join(runs.registry(e, "saved", ["disc", "sector_idx"], F.length("saved") / 2), "saved").select("disc", "sector_idx", "kind", "id", "value_offset", "value_length")


_SIZE = "CASE f WHEN 'mode1' THEN 2048 WHEN 'form1' THEN 2048 WHEN 'form2' THEN 2324 ELSE 0 END"


@query(f"WITH {_SECTORS}, k AS (SELECT disc, sector_idx, {_MODE} AS f FROM s), a AS (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY disc ORDER BY sector_idx) = f THEN 0 ELSE 1 END AS nw FROM k), r AS (SELECT *, sum(nw) OVER (PARTITION BY disc ORDER BY sector_idx) AS rn FROM a), q AS (SELECT *, min(sector_idx) OVER (PARTITION BY disc, rn) AS st FROM r), b AS (SELECT *, st + (sector_idx - st) // 16 * 16 AS bs, {_big(f'coalesce(sum({_SIZE}) OVER (PARTITION BY disc ORDER BY sector_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS sp FROM q) SELECT disc, sector_idx, CASE f WHEN 'audio' THEN 'block' WHEN 'zero' THEN 'none' ELSE 'stream' END AS source, CASE WHEN f = 'audio' THEN bs END AS block_start, CASE f WHEN 'audio' THEN (sector_idx - bs) * 2352 WHEN 'zero' THEN NULL ELSE sp END AS place FROM b")
def disc_sources(spark, d):
    m = stage(optical.sector_map(_discs(spark, d)), "map")
    return optical.sector_sources(m, optical.audio_blocks(m)).drop("kind")


def _stored_edc():
    return F.conv(F.hex(F.concat(*[F.col("sector").substr(2069 - i, 1) for i in range(1, 5)])), 16, 10).cast("long")


@query(f"WITH {_SECTORS} SELECT disc, sector_idx, {_CRC} = ('0x' || substr(h, 4135, 2) || substr(h, 4133, 2) || substr(h, 4131, 2) || substr(h, 4129, 2))::UBIGINT AS edc_ok FROM s")
def edc_check(spark, d):
    s = chunking.sectors_of(_discs(spark, d), "image", ["disc"])
    return s.select("disc", "sector_idx", (disc.edc_of(F.col("sector").substr(1, 2064)) == _stored_edc()).alias("edc_ok"))


@query()
def ecc_check(spark, d):
    s = chunking.sectors_of(_discs(spark, d), "image", ["disc"])
    return s.select("disc", "sector_idx", (disc.edc_of(F.col("sector").substr(1, 2064)) == _stored_edc()).alias("edc_ok"), disc.ecc_ok("sector").alias("ecc_ok"))


# Discs made of the embeddings: one for each label, with sound and broken data sectors of three kinds, and audio

def _make_sectors(batches):
    for rb in batches:
        disc_no, k, n = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        vectors = rb.column(3).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(k), -1).view(np.uint8)
        fill = lambda size: np.tile(vectors, (1, -(-size // vectors.shape[1])))[:, :size]  # noqa: B023, E731
        none, sub = np.zeros((len(k), 8), np.uint8), fill(8) & 0xDF
        sectors = [disc.rebuild("Mode1", fill(2048), none, k + 150), disc.rebuild("Mode2Form1", fill(2048), sub, k + n + 150), disc.rebuild("Mode2Form2", fill(2324), sub | 0x20, k + 2 * n + 150), fill(2352)]
        for x, at in zip(sectors, (2065, 2073, 2349)):
            x[k % 7 == 6, at] ^= 1
        flat = [x[i].tobytes() for x in sectors for i in range(len(k))]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(disc_no, 4).astype(np.int64)), pa.array(np.concatenate([k + i * n for i in range(4)])), pa.array(flat, pa.binary())], names=["disc", "sector_idx", "sector"])


def _made_sectors(spark, d):
    w = Window.partitionBy("label")
    v = table(spark, d, "embeddings").select(F.col("label").cast("long"), (F.row_number().over(w.orderBy("vec_id")) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(w).alias("n"), "embedding")
    return stage(v.mapInArrow(_make_sectors, "disc long, sector_idx long, sector binary"), "made")


def _made(spark, d):
    """(images, tracks): data tracks, then an audio track whose first two sectors are its pregap."""
    images = stage(concatenated(_made_sectors(spark, d), ["disc"], "sector_idx", "sector", "image"), "images")
    n = F.expr(f"octet_length(image) div {4 * disc.SECTOR_BYTES}").cast("long")
    three = F.array(*[F.struct(a.cast("long").alias("track_start"), b.cast("long").alias("content_start"), F.lit(m).alias("track_mode")) for a, b, m in ((F.lit(0), F.lit(0), "MODE1/2352"), (n, n, "MODE2/2352"), (3 * n, 3 * n + F.least(n - 1, F.lit(2)), "AUDIO"))])
    return images, images.select("disc", F.explode(three).alias("t")).select("disc", "t.*")


_MADE = "c AS (SELECT CAST(label AS BIGINT) AS disc, count(*) AS n, least(count(*) - 1, 2) AS g FROM embeddings GROUP BY label)"


@query(f"WITH {_MADE} SELECT disc, kind, sectors FROM (SELECT disc, unnest(['Mode1', 'Mode1Exception', 'Mode2Form1', 'Mode2Form1Exception', 'Mode2Form2', 'Mode2Form2Exception', 'PregapAudio', 'Audio']) AS kind, unnest([n - n // 7, n // 7, n - n // 7, n // 7, n - n // 7, n // 7, g, n - g]) AS sectors FROM c) WHERE sectors > 0")
def made_disc_kinds(spark, d):
    images, tracks = _made(spark, d)
    return optical.sector_map(images, tracks=tracks).groupBy("disc", "kind").agg(F.count(F.lit(1)).alias("sectors"))


@query(f"WITH {_MADE}, r AS (SELECT disc, 3 * n AS st, g AS m FROM c UNION ALL SELECT disc, 3 * n + g, n - g FROM c) SELECT disc, st + 16 * i AS block_start, least(16, m - 16 * i) AS block_count FROM (SELECT *, unnest(range((m + 15) // 16)) AS i FROM r)")
def made_disc_blocks(spark, d):
    images, tracks = _made(spark, d)
    return optical.audio_blocks(optical.sector_map(images, tracks=tracks)).select("disc", "block_start", "block_count")


@query(f"WITH {_MADE} SELECT disc, unnest(range(n)) AS sector_idx, unnest(range(n)) % 7 < 6 AS edc_ok, unnest(range(n)) % 7 < 6 AS ecc_ok FROM c")
def ecc_roundtrip(spark, d):
    """Codes made for data sectors and checked again; a broken byte shows in both."""
    s = _made_sectors(spark, d).join(table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("disc")).agg(F.count(F.lit(1)).alias("n")), "disc").filter("sector_idx < n")
    return s.select("disc", "sector_idx", (disc.edc_of(F.col("sector").substr(1, 2064)) == _stored_edc()).alias("edc_ok"), disc.ecc_ok("sector").alias("ecc_ok"))


@query(f"WITH {_MADE} SELECT row_number() OVER (ORDER BY disc) AS toc_no, printf('made_%08d', disc) AS filename, true AS ok FROM c")
def made_disc_archive(spark, d):
    """Images with audio, a pregap and broken sectors through an archive and back."""
    images, tracks = _made(spark, d)
    path, title = f"{shared_dir(spark)}/stage-made-{uuid.uuid4().hex}.cla", F.format_string("made_%08d", F.col("disc"))
    discs.compress_discs(images.select(title.alias("title"), "image"), path, Settings(optical=True, level=7), tracks.select(title.alias("title"), "track_start", "content_start", "track_mode"))
    return discs.verify_discs(spark, path)


def _disc_archive(spark, d) -> str:
    path = f"{shared_dir(spark)}/stage-discs-{uuid.uuid4().hex}.cla"
    # Numbered by id: the titles of ids of more than eight digits don't sort as numbers.
    images = _discs(spark, d).select(F.format_string("disc_%08d", F.col("disc")).alias("title"), "image", "disc")
    discs.compress_discs(images, path, Settings(optical=True, level=7), order="disc")
    return path


@query("SELECT row_number() OVER (ORDER BY file_id) AS toc_no, printf('disc_%08d', file_id) AS filename, true AS ok FROM filedata WHERE octet_length(file_data) > 0 AND octet_length(file_data) % 2352 = 0")
def disc_archive_verify(spark, d):
    return discs.verify_discs(spark, _disc_archive(spark, d))


@query(f"WITH {_SECTORS}, t AS (SELECT disc, row_number() OVER (ORDER BY disc) AS toc_no FROM (SELECT DISTINCT disc FROM s)) SELECT toc_no AS disc, sector_idx, md5(unhex(h)) AS md5 FROM s JOIN t USING (disc) WHERE sector_idx = 1")
def disc_archive_sector(spark, d):
    path = _disc_archive(spark, d)
    want = extract.selected(spark, path, None).select("toc_no", F.lit(1).cast("long").alias("sector_idx"))
    return discs.disc_sectors(spark, path, want).select("disc", "sector_idx", F.md5("sector").alias("md5"))


# Files on disk, settings, control

def _on_disk(spark, d) -> str:
    """The folder, on a disk all executors share, with a file of each row of filedata."""
    folder = f"{shared_dir(spark)}/stage-files-{uuid.uuid4().hex}"
    sources.write_files(_files(spark, d).select(F.format_string("f%08d.bin", F.col("file_id")).alias("name"), F.col("file_data").alias("data")), folder).count()
    return folder


@query("SELECT printf('f%08d.bin', file_id) AS name, CAST(coalesce(octet_length(file_data), 0) AS BIGINT) AS length FROM filedata")
def folder_listing(spark, d):
    folder = local(_on_disk(spark, d))
    files, _ = sources.organise_paths([f"{folder}/f{i:08d}.bin" for i in range(3)] + [f"{folder}/none"])
    return sources.read_files(spark, [folder, f"{folder}/none"]).unionByName(sources.read_files(spark, files)).select("path", "name", "length").distinct().select("name", "length")


@query("SELECT printf('f%08d.bin', file_id) AS name, md5(coalesce(file_data, ''::BLOB)) AS md5 FROM filedata")
def archive_extract(spark, d):
    """Files on disk through an archive into another folder."""
    path, out = f"{shared_dir(spark)}/stage-extract-{uuid.uuid4().hex}.cla", f"{shared_dir(spark)}/stage-out-{uuid.uuid4().hex}"
    files = sources.read_files(spark, [local(_on_disk(spark, d))]).select(F.col("path").alias("file_id"), F.col("name").alias("file_name"), "content")
    compress.compress(files, path, Settings(level=3))
    extract.extract(spark, path, out, force=True).count()
    return sources.read_files(spark, [local(out)]).select("name", F.md5("content").alias("md5"))


@query(f"WITH {_SECTORS} SELECT printf('disc_%08d', disc) AS title, {_big('count(*) * 2352')} AS bytes, md5(unhex(string_agg(h, '' ORDER BY sector_idx))) AS md5 FROM s GROUP BY disc")
def disc_extract(spark, d):
    """Images through a disc archive into a folder of images and sheets."""
    out = f"{shared_dir(spark)}/stage-out-{uuid.uuid4().hex}"
    discs.extract_discs(spark, _disc_archive(spark, d), out).count()
    f = sources.read_files(spark, [local(out)])
    sheets = f.filter("name like '%.cue'").select(scalars.stem(F.col("name")).alias("title"))
    return f.filter("name like '%.bin'").select(scalars.stem(F.col("name")).alias("title"), F.col("length").alias("bytes"), F.md5("content").alias("md5")).join(sheets, "title")


@query("SELECT index, filename, size_bytes FROM (SELECT row_number() OVER (ORDER BY file_id) AS index, printf('f%08d.bin', file_id) AS filename, CAST(coalesce(octet_length(file_data), 0) AS BIGINT) AS size_bytes FROM filedata)")
def command_line(spark, d):
    """Files on disk through the command line: compress, verify, list."""
    from chunklake import cli

    path = local(f"{shared_dir(spark)}/stage-cli-{uuid.uuid4().hex}.cla")
    with contextlib.redirect_stdout(io.StringIO()):
        if cli.main(["compress", local(_on_disk(spark, d)), "-o", path, "--level", "3"], spark) or cli.main(["verify", path], spark):
            raise RuntimeError("the command line failed")
    return extract.listing(spark, path).select("index", "filename", "size_bytes")


@query("SELECT * FROM (VALUES ('default', 2048, 19), ('file', 4096, 3), ('file and arguments', 4096, 5), ('optical', 8192, 19)) AS t(source, window_bytes, level)")
def settings_precedence(spark, d):
    """Defaults, a file's values over them, and arguments over those."""
    with tempfile.TemporaryDirectory() as folder:
        name = f"{folder}/c.toml"
        rows = [("default", config.load(name))]
        with open(name, "w") as f:
            f.write('window = "4KiB"\nlevel = 3\n')
        rows += [("file", config.load(name)), ("file and arguments", config.merge(config.load(name), {"level": 5, "window": None})), ("optical", Settings(optical=True))]
    return spark.createDataFrame([(n, s.checked().sizes()[0], s.level) for n, s in rows], "source string, window_bytes int, level int")


@query("SELECT * FROM (VALUES ('auto_tune with a window', true), ('auto_tune for discs', true), ('hash of 32 bits', true), ('level 0', true), ('window of 1000', true), ('none', false)) AS t(conflict, refused)")
def settings_conflicts(spark, d):
    cases = {"auto_tune with a window": {"auto_tune": True, "window": 512}, "auto_tune for discs": {"auto_tune": True, "optical": True}, "hash of 32 bits": {"hash_bits": 32}, "level 0": {"level": 0}, "window of 1000": {"window": 1000}, "none": {}}

    def refused(given: dict) -> bool:
        try:
            return config.merge(Settings(), given).checked() is None
        except ValueError:
            return True

    return spark.createDataFrame([(k, refused(v)) for k, v in cases.items()], "conflict string, refused boolean")


@query("SELECT o_orderkey, 0.8 * a > n + least(n, 4294967295) + 4294967295 AS fits FROM (SELECT o_orderkey, CAST(o_totalprice * 100000 AS BIGINT) AS a, o_custkey * 1000000 AS n FROM orders)")
def memory_admission(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100000).cast("long").alias("a"), (F.col("o_custkey") * 1000000).alias("n"))
    return o.select("o_orderkey", scalars.fits_in_memory(F.col("a"), F.col("n")).alias("fits"))


@query("SELECT doc_id, substr(text, 1, 255) AS title FROM documents WHERE text IS NOT NULL")
def disc_titles(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", scalars.title(F.col("text")).alias("title"))


@query("SELECT true AS trained, true AS lossless")
def zstd_optimised(spark, d):
    """A dictionary with its parameters searched for, and all chunks through it and back."""
    chunks = stage(dedup.store(_chunks(spark, d)).select("chunk_hash", "chunk_data"), "store")
    trained = tuning.dictionary(chunks, 8192, optimise=True, cap=1 << 20)
    back = codec.with_codec(codec.with_codec(chunks, "chunk_data", "z", "compress", trained, 3), "z", "back", "decompress", trained)
    return back.agg(F.min(F.col("back") == F.col("chunk_data")).alias("lossless")).select(F.lit(0 < len(trained) <= 8192).alias("trained"), "lossless")


@query("SELECT true AS finished, true AS tasks_counted")
def job_progress(spark, d):
    name = f"job-{uuid.uuid4().hex}"
    with job(spark, name):
        table(spark, d, "lineitem").agg(F.sum("l_quantity")).collect()
        for _ in range(50):  # the tracker hears of the end a little later
            done, tasks = progress(spark, name)
            if tasks and done == tasks:
                break
            time.sleep(0.1)
    return spark.createDataFrame([(done == tasks, tasks > 0)], "finished boolean, tasks_counted boolean")


# Streaming

@query("SELECT true AS same, true AS once")
def ingest_store(spark, d):
    """Arriving files through the stream, twice, into a store, against the store of the same files in one batch."""
    folder, base = _on_disk(spark, d), f"{shared_dir(spark)}/stage-ingest-{uuid.uuid4().hex}"
    for k in ("a", "b"):
        ingest.ingest(spark, local(folder), f"{base}/store", f"{base}/checkpoint-{k}", most=200, digits=1).awaitTermination()
    got = spark.read.parquet(f"{base}/store").groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("n"))
    want = dedup.keys(chunking.content_chunks(_files(spark, d), "file_data", ["file_id"])).withColumn("m", F.lit(1))
    both = got.join(want, "chunk_hash", "full")
    return both.agg(F.count_if(F.col("n").isNull() | F.col("m").isNull()).alias("differ"), F.max("n").alias("most")).select((F.col("differ") == 0).alias("same"), (F.col("most") == 1).alias("once"))


@query("SELECT date_trunc('hour', received_at) AS window_start, count(*) AS messages, count(chunk_hash) AS keyed FROM chunkmessage GROUP BY 1")
def windowed_arrivals(spark, d):
    return ingest.windowed_arrivals(table(spark, d, "chunkmessage"))


@query(f"SELECT n AS streamed, n AS keys, n AS batch, true AS equal FROM (SELECT count(DISTINCT {_KEY}) AS n FROM chunkmessage)")
def stream_equals_batch(spark, d):
    """The messages' keys through a stream into a store, against the batch's store: one row, equal or not."""
    base = f"{shared_dir(spark)}/stage-stream-{uuid.uuid4().hex}"
    src = table(spark, d, "chunkmessage").select(F.col("msg_id").cast("string").alias("path"), F.lit(0).cast("long").alias("chunk_offset"), canonical_key(F.col("chunk_hash")).alias("chunk_hash"), "chunk_data")
    src.repartition(4).write.parquet(f"{base}/in")
    read = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    run = read.writeStream.foreachBatch(lambda df, _: ingest.append_new(df, f"{base}/store", digits=1)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(f"{base}/store").agg(F.count(F.lit(1)).alias("streamed"), F.countDistinct("chunk_hash").alias("keys"))
    want = dedup.keys(src).agg(F.count(F.lit(1)).alias("batch")).scalar()
    return got.withColumn("batch", want).withColumn("equal", (F.col("streamed") == F.col("batch")) & (F.col("keys") == F.col("batch")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
