"""Disc images as tables: sector maps, their runs, audio blocks, user-data chunks, exceptions, and rebuilding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.functions import disc
from chunklake.functions.hashing import chunk_hash
from chunklake.operators.chunking import run_blocks, sectors_of, stream_chunks
from chunklake.operators.concat import concatenated
from chunklake.operators.joins import asof
from chunklake.operators.runs import change_points, runs

AUDIO_KINDS = ("Audio", "PregapAudio", "ZeroedAudio")


def sector_map(images: DataFrame, ident: str = "disc", data: str = "image", tracks: DataFrame | None = None) -> DataFrame:
    """(disc, sector_idx, kind, sector). With tracks (disc, track_start, content_start, track_mode), sectors before the first track are
    PregapAudio, those between a track's start and content its pregap, audio tracks aren't looked into, and others are
    classified by their codes. Without tracks every sector is classified. One pass over the sectors; a batch at a time."""
    s = sectors_of(images, data, [ident])
    if tracks is None:
        return s.select(ident, "sector_idx", disc.sector_kind("sector", "sector_idx").alias("kind"), "sector")
    t = tracks.select(ident, "track_start", F.struct("track_start", "content_start", "track_mode").alias("track"))
    placed = asof(s, t, [ident], "sector_idx", "track_start", "track")
    pre = F.col("sector_idx") < F.col("track.content_start")
    looked = disc.sector_kind(F.when(F.col("track.track_mode") != "AUDIO", F.col("sector")), F.col("sector_idx"))
    audio = F.when(pre, F.lit("PregapAudio")).otherwise(F.lit("Audio"))
    of_data = placed.withColumn("_k", looked)
    in_pregap = F.when(F.col("_k") == "Mode1", "PregapMode1").when(F.col("_k") == "Mode1Exception", "PregapMode1Exception").when(F.col("_k").isin("Mode2Form1", "Mode2Form2"), "PregapMode2").when(F.col("_k").isin("Mode2Form1Exception", "Mode2Form2Exception"), "PregapMode2Exception").otherwise(F.col("_k"))
    zero = F.when(F.col("_k") == "ZeroedMode1Data", F.when(F.col("track.track_mode").startswith("MODE2"), "ZeroedMode2Data").otherwise("ZeroedMode1Data")).otherwise(F.col("_k"))
    kind = F.when(F.col("track").isNull(), F.lit("PregapAudio")).when(F.col("track.track_mode") == "AUDIO", audio).when(pre, in_pregap).otherwise(zero)
    return of_data.select(ident, "sector_idx", kind.alias("kind"), "sector")


def kind_runs(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    return runs(mapped.select(ident, "sector_idx", "kind"), [ident], "sector_idx", "kind")


def audio_blocks(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, run_no, block_no, block_start, block_count, kind): 16 sectors a block, restarting at each audio run."""
    r = kind_runs(mapped, ident).filter(F.col("kind").isin(*AUDIO_KINDS))
    return run_blocks(r, "run_start", "run_length").select(ident, "run_no", "block_no", "block_start", "block_count", "kind")


def user_sectors(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, run_no, run_start, kind, sector_idx, user): the user data of each sector of the runs of data sectors."""
    r = kind_runs(mapped, ident).filter(~F.col("kind").isin(*AUDIO_KINDS)).select(ident, "run_no", "run_start", (F.col("run_start") + F.col("run_length")).alias("run_end"))
    # Each sector meets the last run that began at or before it; the runs of the audio lie between.
    hit = asof(mapped, r.select(ident, "run_start", F.struct("run_no", "run_start", "run_end").alias("run")), [ident], "sector_idx", "run_start", "run")
    return hit.filter(F.col("run").isNotNull() & (F.col("sector_idx") < F.col("run.run_end"))).select(ident, "run.run_no", "run.run_start", "kind", "sector_idx", disc.user_data(F.col("sector"), F.col("kind")).alias("user"))


def user_stream(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, run_no, run_start, kind, stream): the user data of each run, one after the other, for runs that fit a row (2 GiB)."""
    return concatenated(user_sectors(mapped, ident), [ident, "run_no", "run_start", "kind"], "sector_idx", "user", "stream")


def user_chunks(mapped: DataFrame, ident: str = "disc", window: int = 8192, level: int = 0) -> DataFrame:
    """Content-defined chunks of each run's user data; the chunker starts anew at each run. Sectors stream through: no run is one value."""
    return stream_chunks(user_sectors(mapped, ident), [ident, "run_no"], "sector_idx", "user", window, level)


def exceptions(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, sector_idx, kind, saved): what exceptional sectors keep, pregap ones too."""
    return mapped.filter(F.col("kind").endswith("Exception")).select(ident, "sector_idx", "kind", disc.sector_exception("sector", "kind").alias("saved"))


def _extra(sector, kind):
    at = F.when(kind.isin(*[k for k, r in disc.KINDS.items() if r[5] == 2068]), F.lit(2069)).when(kind.isin(*[k for k, r in disc.KINDS.items() if r[5] == 16]), F.lit(17))
    return F.when(at.isNotNull(), sector.substr(at, F.lit(8)))


def subheaders(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, run_no, run_start, run_length, extra): runs of equal extra bytes of data sectors; a gap ends a run."""
    rows = mapped.select(ident, "sector_idx", F.hex(_extra(F.col("sector"), F.col("kind"))).alias("extra")).filter("extra is not null")
    return runs(rows, [ident], "sector_idx", "extra", contiguous=True)


def addresses(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, from_sector, lba_offset): where the difference of a data sector's address to its index changes."""
    b = lambda i: F.conv(F.hex(F.col("sector").substr(i, 1)), 16, 10).cast("int")
    bcd = lambda x: F.shiftright(x, 4) * 10 + x.bitwiseAND(F.lit(15))
    lba = ((bcd(b(13)) * 60 + bcd(b(14))) * 75 + bcd(b(15))).cast("long")
    rows = mapped.filter(~F.col("kind").isin(*AUDIO_KINDS, "ZeroedMode1Data", "ZeroedMode2Data")).select(ident, "sector_idx", (lba - F.col("sector_idx")).alias("lba_offset")).filter("lba_offset >= 0")
    return change_points(rows, [ident], "sector_idx", "lba_offset").select(ident, F.col("sector_idx").alias("from_sector"), "lba_offset")


def shredded(mapped: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, sector_idx, kind, user, extra, saved): what is kept of each sector; its address comes from the address map."""
    k = F.col("kind")
    return mapped.select(ident, "sector_idx", "kind", disc.user_data(F.col("sector"), k).alias("user"), _extra(F.col("sector"), k).alias("extra"), disc.sector_exception("sector", "kind").alias("saved"))


def _rebuild_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        kinds = np.array(rb.column(2).to_pylist(), dtype=object)
        users, extras, saved = (rb.column(i).to_pylist() for i in (3, 4, 5))
        lba = rb.column(6).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * rb.num_rows
        for kind in set(kinds):
            at = np.flatnonzero(kinds == kind)
            grid = lambda vals, at=at: np.frombuffer(b"".join(vals[i] or b"" for i in at), np.uint8).reshape(len(at), -1)
            full = disc.rebuild(kind, grid(users), grid(extras) if extras[at[0]] else None, lba[at], grid(saved) if saved[at[0]] else None)
            for i, row in zip(at, full):
                out[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, pa.binary())], names=["disc", "sector_idx", "sector"])


def rebuilt(parts: DataFrame, address_map: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, sector_idx, sector) from shredded parts; the address is the index plus the last offset at or before it, 0 if none.
    Filter parts by sector_idx before this for single sectors: nothing else is read."""
    lba = asof(parts, address_map, [ident], "sector_idx", "from_sector", "lba_offset", F.lit(0).cast("long"))
    rows = lba.select(F.col(ident).cast("long").alias("disc"), F.col("sector_idx").cast("long"), "kind", "user", "extra", "saved", (F.col("sector_idx") + F.col("lba_offset")).cast("long").alias("lba"))
    return rows.mapInArrow(_rebuild_batches, "disc long, sector_idx long, sector binary")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sectors sorted by disc and index: each disc's digests, a sector at a time."""
    import xxhash

    now, sha, xxh, n = None, None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([sha.hexdigest()]), pa.array([xxh.hexdigest()])], names=["disc", "sectors", "sha512", "xxh3"])

    for rb in batches:
        for d, s in zip(rb.column(0).to_pylist(), rb.column(2)):
            if d != now:
                if now is not None:
                    yield row()
                now, sha, xxh, n = d, hashlib.sha512(), xxhash.xxh3_64(), 0
            raw = s.as_py()
            sha.update(raw)
            xxh.update(raw)
            n += 1
    if now is not None:
        yield row()


def disc_digests(sectors: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, sectors, sha512, xxh3): both digests of each disc's ordered sectors, streamed; no disc is held whole."""
    rows = sectors.select(F.col(ident).cast("long").alias("disc"), F.col("sector_idx").cast("long").alias("sector_idx"), "sector")
    return rows.repartition("disc").sortWithinPartitions("disc", "sector_idx").mapInArrow(_digest_batches, "disc long, sectors long, sha512 string, xxh3 string")


def disc_sizes(rle: DataFrame, ident: str = "disc") -> DataFrame:
    return rle.groupBy(ident).agg((F.sum("run_length") * disc.SECTOR_BYTES).cast("long").alias("image_bytes"))


def sector_sources(mapped: DataFrame, blocks: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, sector_idx, source, block_start, place): where each sector's bytes come from: its audio block and the byte in it, the data
    stream, or nothing for zeroed sectors. Pregap data comes from the stream."""
    b = blocks.select(ident, "block_start", F.struct("block_start", "block_count").alias("block"))
    hit = asof(mapped.select(ident, "sector_idx", "kind"), b, [ident], "sector_idx", "block_start", "block")
    inside = F.col("block").isNotNull() & (F.col("sector_idx") < F.col("block.block_start") + F.col("block.block_count")) & F.col("kind").isin("Audio", "PregapAudio")
    source = F.when(inside, F.lit("block")).when(F.col("kind").isin("ZeroedMode1Data", "ZeroedMode2Data", "ZeroedAudio", "None"), F.lit("none")).otherwise(F.lit("stream"))
    size = disc.data_size(F.col("kind"))
    w = Window.partitionBy(ident).orderBy("sector_idx").rowsBetween(Window.unboundedPreceding, -1)
    streamed = hit.withColumn("source", source).withColumn("_n", F.when(F.col("source") == "stream", size).otherwise(F.lit(0)))
    place = F.when(F.col("source") == "block", (F.col("sector_idx") - F.col("block.block_start")) * disc.SECTOR_BYTES).when(F.col("source") == "stream", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return streamed.select(ident, "sector_idx", "kind", "source", F.when(F.col("source") == "block", F.col("block.block_start")).alias("block_start"), place.cast("long").alias("place"))


def block_hashes(mapped: DataFrame, blocks: DataFrame, ident: str = "disc") -> DataFrame:
    """(disc, block_start, block_count, block_hash, block_data): the audio blocks' bytes under their seeded hash."""
    b = blocks.select(ident, "block_start", F.struct("block_start", "block_count").alias("block"))
    hit = asof(mapped.filter(F.col("kind").isin(*AUDIO_KINDS)), b, [ident], "sector_idx", "block_start", "block")
    rows = hit.select(ident, "block.block_start", "block.block_count", "sector_idx", "sector")
    joined = concatenated(rows, [ident, "block_start", "block_count"], "sector_idx", "sector", "block_data")
    return joined.withColumn("block_hash", chunk_hash(F.col("block_data")))
