"""The disc pipeline: images and their sheets to a disc archive, and back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.functions import disc
from chunklake.functions.codec import with_codec
from chunklake.functions.scalars import title
from chunklake.operators import cue, dedup, layout, optical, tuning
from chunklake.operators.concat import concatenated
from chunklake.operators.joins import interval_join
from chunklake.operators.prefix import global_running_sum
from chunklake.session import merged, stage
from chunklake.sources.archive import DISC, fetch_chunks, read_archive, write_archive
from chunklake.sources.config import Settings
from chunklake.sources.files import read_files, read_texts
from chunklake.sources.ranges import filesystem

OPTICAL = Settings(optical=True)


def discs_of_folders(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, tracks, collections) of folders with CUE sheets, their images and playlists.

    A sheet's images are looked up beside it, by name, and put one after the other. images: (title, image); tracks: (title,
    track_start, content_start, track_mode); collections: (title, collection_id).
    """
    found = read_files(spark, paths)
    folder = lambda c: F.regexp_replace(c, r"[^/]*$", "")
    sheets = read_texts(spark, paths, "cue").select(F.regexp_replace("name", r"\.[^.]*$", "").alias("title"), folder(F.col("path")).alias("folder"), "text")
    indices = cue.parse_cue(sheets.select(F.col("title").alias("sheet"), "text"))
    places = indices.join(sheets.select(F.col("title").alias("sheet"), "folder"), "sheet")
    named = found.select(folder(F.col("path")).alias("folder"), F.col("name").alias("file_name"), F.col("length").alias("size"), "path")
    parts = places.select("sheet", "folder", "file_no", "file_name").distinct().join(named, ["folder", "file_name"], "left")
    placed = cue.normalised(indices, parts.select("sheet", "file_name", "size"))
    tracks = cue.track_starts(placed, at="position").select(F.col("sheet").alias("title"), "track_start", "content_start", "track_mode")
    data = parts.join(found.select("path", "content"), "path")
    images = concatenated(data.withColumnRenamed("sheet", "title"), ["title"], "file_no", "content", "image")
    lists = read_texts(spark, paths, "m3u").unionByName(read_texts(spark, paths, "m3u8"))
    lines = lists.select(F.col("path").alias("playlist_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line_text"))
    return images, tracks, cue.collections(cue.playlist_entries(lines))


def compress_discs(images: DataFrame, path: str, settings: Settings = OPTICAL, tracks: DataFrame | None = None, collections: DataFrame | None = None, order: str = "title") -> dict:
    """Writes a disc archive of images (title, image) of whole sectors; returns figures. `order` is the column of images that numbers them.

    Sectors are mapped to kinds, kinds to runs; user data is chunked for each run, audio kept in blocks of 16 sectors, and both are
    deduplicated under their hashes. What the codes and addresses of sound sectors say isn't kept, since it can be made again.
    """
    settings = settings.checked()
    window, size = settings.sizes()
    one = images.select("title", F.octet_length("image").cast("long").alias("uncompressed_size"), F.lit(1).alias("_one"), F.col(order).alias("_order"))
    toc = stage(global_running_sum(one, [F.col("_order")], "_one", "toc_no").select("title", "uncompressed_size", (F.col("toc_no") + 1).alias("toc_no")), "toc")
    wrong = F.raise_error(F.concat(F.lit("no whole sectors: "), F.col("title"))).cast("long")
    numbered = images.join(toc.select("title", "toc_no"), "title").select(F.when(F.octet_length("image") % disc.SECTOR_BYTES != 0, wrong).otherwise(F.col("toc_no")).alias("disc"), "image")
    starts = tracks.join(toc.select("title", "toc_no"), "title").withColumnRenamed("toc_no", "disc") if tracks is not None else None
    m = stage(optical.sector_map(numbered, tracks=starts), "map")
    r = stage(optical.kind_runs(m), "runs")
    data = optical.user_chunks(m, window=window, level=settings.normalisation).select("disc", "run_no", "chunk_no", "chunk_hash", "chunk_offset", "chunk_length", "chunk_data", F.lit(0).alias("codec"))
    blocks = optical.audio_blocks(m)
    audio = optical.block_hashes(m, blocks).join(blocks.select("disc", "block_start", "run_no", "block_no"), ["disc", "block_start"])
    audio = audio.select("disc", "run_no", F.col("block_no").cast("int").alias("chunk_no"), F.col("block_hash").alias("chunk_hash"), (F.col("block_no") * 16 * disc.SECTOR_BYTES).alias("chunk_offset"), F.octet_length("block_data").alias("chunk_length"), F.col("block_data").alias("chunk_data"), F.lit(1).alias("codec"))
    chunks = stage(data.unionByName(audio), "chunks")
    coded = chunks.withColumn("chunk_hash", F.concat(F.when(F.col("codec") == 1, "a").otherwise("d"), "chunk_hash"))
    store = stage(dedup.store(coded, order=("disc", "run_no", "chunk_offset")), "store")
    plain = store.filter(F.col("chunk_hash").startswith("d"))
    d = tuning.dictionary(plain, size, optimise=settings.optimise_dictionary, cap=settings.dictionary_sample)
    packed = with_codec(plain.select("chunk_hash", "chunk_data"), "chunk_data", "compressed", "compress", d, settings.level).withColumn("codec", F.lit(0))
    sound = with_codec(store.filter(F.col("chunk_hash").startswith("a")).select("chunk_hash", "chunk_data"), "chunk_data", "compressed", "audio").withColumn("codec", F.lit(1))
    all_ = stage(packed.unionByName(sound).drop("chunk_data").withColumn("compressed_length", F.octet_length("compressed")), "coded")
    placed = stage(layout.hash_layout(all_.select("chunk_hash", "compressed_length"), length="compressed_length").select("chunk_hash", "position", "layout_offset").join(merged(all_), "chunk_hash"), "packed")
    address = stage(optical.addresses(m), "addresses")
    digest = optical.disc_digests(m)
    texts = cue.cue_text(cue.cue_tracks(r, "disc", F.col("kind")).join(toc.select(F.col("toc_no").alias("disc"), "title"), "disc"), "disc", F.concat("title", F.lit(".bin")))
    if collections is None:
        names = toc.withColumn("collection_id", F.lit(None).cast("int"))
    else:
        names = toc.join(collections, "title", "left")
    seq = lambda df: df.withColumn("seq", F.col("disc")).withColumnRenamed("disc", "toc_no")
    tables = {
        "toc": names.join(digest.select(F.col("disc").alias("toc_no"), "sha512"), "toc_no", "left").select(F.col("toc_no").alias("seq"), "toc_no", title(F.col("title")).alias("filename"), "uncompressed_size", "sha512", "collection_id"),
        "layout": seq(coded.drop("chunk_data", "codec")),
        "index": placed.select(F.col("position").alias("seq"), "chunk_hash", F.col("layout_offset").alias("data_offset"), "compressed_length", "codec"),
        "runs": seq(r),
        "subheaders": seq(optical.subheaders(m)),
        "addresses": seq(address),
        "exceptions": seq(optical.exceptions(m)),
        "discs": seq(digest.join(texts, "disc", "left")),
    }
    n = toc.count()
    write_archive(path, tables, placed.select(F.col("position").alias("seq"), F.col("compressed").alias("payload")), d, n, settings.hash_bits, DISC, settings.force)
    c, total = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("compressed_length"), F.lit(0))).first()
    return {"discs": n, "bytes": toc.agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0))).first()[0], "unique_chunks": c, "compressed_bytes": total}


def disc_sectors(spark: SparkSession, path: str, sectors: DataFrame | None = None) -> DataFrame:
    """(disc, sector_idx, sector) of an archive's images, or of the wanted (toc_no, sector_idx) only.

    Each sector asks for its bytes of its run's stream; runs' chunks meet them by run and bucket of bytes, so that a single
    sector reads a chunk or two, and no run or image is ever one row.
    """
    t = lambda name: read_archive(spark, path, name)
    each = t("runs").select("toc_no", "run_no", "run_start", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("run_length") - 1)).alias("i"))
    size = disc.data_size(F.col("kind")).cast("long")
    asks = each.select("toc_no", "run_no", (F.col("run_start") + F.col("i")).alias("sector_idx"), "kind", (F.col("i") * size).alias("at"), ((F.col("i") + 1) * size).alias("to"))
    if sectors is not None:
        asks = asks.join(sectors.select("toc_no", "sector_idx"), ["toc_no", "sector_idx"], "left_semi")
    rows = t("layout").withColumn("end", F.col("chunk_offset") + F.col("chunk_length")).drop("chunk_no", "chunk_length")
    hits = interval_join(asks, rows, ["toc_no", "run_no"], "at", "to", "chunk_offset", "end", 1 << 15)
    d = bytes(t("dictionary").first()[0])
    data = with_codec(fetch_chunks(spark, path, hits), "compressed", "chunk_data", "stored", d)
    lo, hi = F.greatest("at", "chunk_offset"), F.least("to", "end")
    piece = F.hex(F.col("chunk_data").substr((lo - F.col("chunk_offset") + 1).cast("int"), (hi - lo).cast("int")))
    user = hits.join(data.select("chunk_hash", "chunk_data"), "chunk_hash").groupBy("toc_no", "sector_idx", "kind").agg(F.array_sort(F.collect_list(F.struct("chunk_offset", piece.alias("p")))).alias("p"))
    extra = t("subheaders").select("toc_no", F.explode(F.sequence("run_start", F.col("run_start") + F.col("run_length") - 1)).alias("sector_idx"), F.unhex("extra").alias("extra"))
    parts = (
        user.select(F.col("toc_no"), "sector_idx", "kind", F.unhex(F.array_join(F.transform("p", lambda x: x["p"]), "")).alias("user"))
        .join(extra, ["toc_no", "sector_idx"], "left")
        .join(t("exceptions"), ["toc_no", "sector_idx"], "left")
        .withColumnRenamed("toc_no", "disc")
    )
    return optical.rebuilt(parts, t("addresses").withColumnRenamed("toc_no", "disc"))


def verify_discs(spark: SparkSession, path: str) -> DataFrame:
    """(toc_no, filename, ok) of each image, rebuilt and held against both stored digests."""
    t = lambda name: read_archive(spark, path, name)
    got = optical.disc_digests(disc_sectors(spark, path)).select(F.col("disc").alias("toc_no"), F.col("sha512").alias("s"), F.col("xxh3").alias("x"))
    ok = F.coalesce((F.col("sha512") == F.col("s")) & (F.col("xxh3") == F.col("x")), F.lit(False))
    return t("toc").select("toc_no", "filename").join(t("discs").drop("cue"), "toc_no", "left").join(got, "toc_no", "left").select("toc_no", "filename", ok.alias("ok"))


def _write_images(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, temp, n = None, None, None, 0
        own, inside = filesystem(folder)

        def close() -> pa.RecordBatch:
            out.close()
            own.move(temp, f"{inside}/{now[1]}.bin")
            with own.open_output_stream(f"{inside}/{now[1]}.cue") as f:
                f.write((now[2] or "").encode())
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]]), pa.array([n], pa.int64())], names=["toc_no", "title", "sectors"])

        for rb in batches:
            for key, sector in zip(zip(*(rb.column(i).to_pylist() for i in (0, 1, 2))), rb.column(4)):
                if key != now:
                    if now is not None:
                        yield close()
                    now, n = key, 0
                    temp = f"{inside}/.{uuid.uuid4().hex}.part"
                    out = own.open_output_stream(temp)
                out.write(sector.as_py())
                n += 1
        if now is not None:
            yield close()

    return run


def extract_discs(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes each image and its sheet into a folder all executors share; (toc_no, title, sectors). Images are checked first."""
    bad = verify_discs(spark, path).filter("not ok").first()
    if bad is not None:
        raise ValueError(f"damaged: {bad.filename}")
    names = read_archive(spark, path, "toc").select(F.col("toc_no").alias("disc"), F.regexp_replace("filename", r"[/\\\x00]", "_").alias("title")).join(read_archive(spark, path, "discs").select(F.col("toc_no").alias("disc"), "cue"), "disc")
    own, inside = filesystem(folder)
    own.create_dir(inside)
    rows = disc_sectors(spark, path).join(names, "disc").select("disc", "title", "cue", "sector_idx", "sector")
    return rows.repartition("disc").sortWithinPartitions("disc", "sector_idx").mapInArrow(_write_images(folder), "toc_no long, title string, sectors long")
