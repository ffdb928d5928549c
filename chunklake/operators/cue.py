"""CUE sheets and playlists: parsing, checks, sector positions, normalising, generation; native windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.functions.disc import is_pregap, track_mode, track_type
from chunklake.functions.scalars import base_name, frames_to_msf, msf_text, parse_msf, stem
from chunklake.operators.prefix import global_running_sum

FILE_LINE = r'^\s*FILE\s+"([^"]*)"\s+(\S+)'
TRACK_LINE = r"^\s*TRACK\s+(\d+)\s+(\S+)"
INDEX_LINE = r"^\s*INDEX\s+(\d+)\s+(\d+:\d+:\d+)"


def sheet_lines(sheets: DataFrame, sheet: str = "sheet", text: str = "text") -> DataFrame:
    return sheets.select(sheet, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def parse_cue(sheets: DataFrame, sheet: str = "sheet", text: str = "text") -> DataFrame:
    """(sheet, file_no, file_name, track_no, track_mode, index_no, frames): one row for each INDEX line.

    FILE lines must be BINARY, a TRACK needs a FILE before it and an INDEX a TRACK of its file: else an error is raised. Modes
    are accepted in any case. Other lines are ignored, null texts have no lines.
    """
    lines = sheet_lines(sheets, sheet, text)
    some = lambda pat, i: F.nullif(F.regexp_extract("line", pat, i), F.lit(""))
    w = Window.partitionBy(sheet).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(
        sheet, "line_no", some(FILE_LINE, 1).alias("f"), some(FILE_LINE, 2).alias("f_type"), some(TRACK_LINE, 1).cast("int").alias("t"), some(TRACK_LINE, 2).alias("t_mode"), some(INDEX_LINE, 1).cast("int").alias("i"), some(INDEX_LINE, 2).alias("i_at")
    ).withColumn("file_no", F.count("f_type").over(w))
    own = Window.partitionBy(sheet, "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = (
        marked.withColumn("file_name", F.last("f", True).over(own))
        .withColumn("file_type", F.last("f_type", True).over(own))
        .withColumn("track_no", F.last("t", True).over(own))
        .withColumn("mode", F.last("t_mode", True).over(own))
    )
    wrong = (
        F.when(F.col("t").isNotNull() & (F.col("file_no") == 0), F.lit("TRACK before FILE"))
        .when(F.col("i").isNotNull() & F.col("track_no").isNull(), F.lit("INDEX before TRACK"))
        .when(F.col("f_type").isNotNull() & (F.upper("f_type") != "BINARY"), F.concat(F.lit("file type "), F.col("f_type")))
    )
    # The check is part of the kept column, so that it is made on every line, whatever filters follow.
    failed = F.raise_error(F.concat(F.col(sheet).cast("string"), F.lit(": "), wrong)).cast("int")
    checked = carried.withColumn("i", F.when(wrong.isNotNull(), failed).otherwise(F.col("i")))
    return checked.filter("i is not null").select(sheet, F.col("file_no").cast("int").alias("file_no"), "file_name", "track_no", track_type(F.col("mode")).alias("track_mode"), F.col("i").alias("index_no"), parse_msf(F.col("i_at")).alias("frames"))


def normalised(indices: DataFrame, sizes: DataFrame, sheet: str = "sheet") -> DataFrame:
    """The indices of a sheet of several images as positions in their concatenation: adds base and frames plus base, in sectors.

    sizes has (sheet, file_name, size); an unknown file, or a size that isn't whole sectors, raises an error.
    """
    files = indices.select(sheet, "file_no", "file_name").distinct().join(sizes.select(sheet, "file_name", "size"), [sheet, "file_name"], "left")
    bad = F.when(F.col("size").isNull(), F.lit("no such image: ")).when(F.col("size") % 2352 != 0, F.lit("no whole sectors: "))
    sectors = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col("file_name"))).cast("long")).otherwise(F.expr("size div 2352"))
    w = Window.partitionBy(sheet).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("sectors", sectors).withColumn("base", F.coalesce(F.sum("sectors").over(w), F.lit(0)).cast("long")).select(sheet, "file_no", "sectors", "base")
    return indices.join(based, [sheet, "file_no"]).withColumn("position", F.col("frames") + F.col("base"))


def track_starts(indices: DataFrame, sheet: str = "sheet", at: str = "frames") -> DataFrame:
    """(sheet, track_no, track_mode, content_start, track_start, next_start): INDEX 01, INDEX 00 or else 01, and the next track's
    start (null for the last). A track without INDEX 01 raises an error."""
    one, zero = F.max(F.when(F.col("index_no") == 1, F.col(at))), F.max(F.when(F.col("index_no") == 0, F.col(at)))
    got = indices.groupBy(sheet, "track_no").agg(F.max("track_mode").alias("track_mode"), one.alias("c"), F.coalesce(zero, one).alias("track_start"))
    content = F.when(F.col("c").isNull(), F.raise_error(F.concat(F.lit("no INDEX 01 in track "), F.col("track_no").cast("string"))).cast("long")).otherwise(F.col("c"))
    w = Window.partitionBy(sheet).orderBy("track_start", "track_no")
    return got.select(sheet, "track_no", "track_mode", content.alias("content_start"), "track_start").withColumn("next_start", F.lead("track_start").over(w))


def cue_tracks(rle: DataFrame, disc: str, kind: Column, start: str = "run_start", count: str = "run_length", no: str = "run_no") -> DataFrame:
    """(disc, track_no, mode, index00, index01): a new track begins at the first run, where the mode changes, and at every pregap run;
    the run after a pregap run with the same mode gives its INDEX 01."""
    w = Window.partitionBy(disc).orderBy(no)
    marked = rle.select(disc, no, start, count, track_mode(kind).alias("mode"), is_pregap(kind).alias("pre"))
    new = (F.row_number().over(w) == 1) | (F.col("mode") != F.lag("mode").over(w)) | F.col("pre")
    tracks = marked.withColumn("n", new.cast("int"))
    tracks = tracks.withColumn("track_no", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return tracks.groupBy(disc, "track_no").agg(
        F.min_by("mode", no).alias("mode"),
        F.min(F.when(F.col("pre"), F.col(start))).alias("index00"),
        F.coalesce(F.min(F.when(~F.col("pre"), F.col(start))), F.max(F.col(start) + F.col(count))).alias("index01"),
    )


def cue_text(tracks: DataFrame, disc: str, name: Column) -> DataFrame:
    """(disc, cue): the sheet's text, always one BINARY file."""
    at = lambda c: msf_text(frames_to_msf(F.col(c)))
    body = F.concat(
        F.format_string("  TRACK %02d ", F.col("track_no")),
        F.col("mode"),
        F.lit("\n"),
        F.when(F.col("index00").isNotNull(), F.concat(F.lit("    INDEX 00 "), at("index00"), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("    INDEX 01 "),
        at("index01"),
        F.lit("\n"),
    )
    lines = tracks.withColumn("_name", name).select(disc, "_name", "track_no", body.alias("body"))
    parts = lines.groupBy(disc).agg(F.first("_name").alias("n"), F.array_sort(F.collect_list(F.struct("track_no", "body"))).alias("b"))
    return parts.select(disc, F.concat(F.lit('FILE "'), F.col("n"), F.lit('" BINARY\n'), F.array_join(F.transform("b", lambda x: x["body"]), "")).alias("cue"))


def playlist_entries(lines: DataFrame, playlist: str = "playlist_id", no: str = "line_no", text: str = "line_text") -> DataFrame:
    """(playlist, line_no, title): the stem of each entry; blank lines and lines that begin with # are none. Line ends, blanks
    around and folders don't matter."""
    t = F.regexp_replace(F.col(text), r"^[\s\x{FEFF}]+|\s+$", "")
    return lines.select(playlist, no, t.alias("_t")).filter((F.col("_t") != "") & ~F.col("_t").startswith("#")).select(playlist, no, stem(base_name(F.col("_t"))).alias("title"))


def collections(entries: DataFrame, playlist: str = "playlist_id") -> DataFrame:
    """(title, collection_id): playlists with entries are numbered from 0, modulo 256, in order; of several the last one counts."""
    one = entries.select(playlist).distinct().withColumn("_one", F.lit(1))
    ids = global_running_sum(one, [F.col(playlist)], "_one", "_n").select(playlist, (F.col("_n") % 256).cast("int").alias("collection_id"))
    return entries.join(ids, playlist).groupBy("title").agg(F.max_by("collection_id", playlist).alias("collection_id"))
