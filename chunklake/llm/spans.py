"""Long exact spans shared between records (problem 4): seed with winnowed anchors, extend both ways, keep maximal runs.

A span of 256 bytes has 193 grams of 64 bytes; the one with the smallest hash (the last of equals) is the span's anchor, so
that equal spans have equal anchors wherever they lie. Consecutive spans with one anchor are together the anchor's reach, up
to 192 bytes to its left and as many to its right. Records are joined on anchors. Where whole reaches are equal, one comparison
of hashes extends the match to both ends of the reach; where anchors are equal and reaches are not, the bytes around
the anchor are compared position by position. A run that goes on beyond a reach is taken up by the next anchor, and
overlapping or touching pieces are merged to maximal spans. No pairs of records are made at any time: what is equal is
grouped by its hash, and a group's smallest and largest file id tell whether there is another file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.llm.bytesets import binary_parts, mix, rolling_hashes, stretches
from chunklake.session import fitted, merged, stage

LEAST = 256
GRAM = 64
WIDTH = LEAST - GRAM + 1
_POS_BITS = 24
_SEEDS = "file_id long, anchor long, reach long, back int, ahead int, starts array<int>, repeats array<int>"
_AROUND = "anchor long, reach long, lo long, hi long, bytes binary"


def last_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of the smallest by its upper 40 bits, the last of equals.

    The place is kept in the lower bits, reversed, so that one running minimum gives both. h may have up to 2^24 values.
    """
    mask = np.uint64((1 << _POS_BITS) - 1)
    low = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    n, size = len(h) - width + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    return (mask - (low & mask)).astype(np.int64)


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        ids = rb.column(0).to_numpy(zero_copy_only=False)
        offsets, data = binary_parts(rb.column(1))
        for lo, hi in stretches(offsets, LEAST):
            got = rolling_hashes(data[lo:hi], (GRAM, LEAST))
            gram, span = got[GRAM], got[LEAST]
            place = last_minima(gram, WIDTH)
            at = np.arange(lo, lo + len(span))
            owner = np.searchsorted(offsets, at, side="right") - 1
            whole = at + LEAST <= offsets[owner + 1]
            new = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(span)] - 1
            keep = whole[first]
            first, last = first[keep], last[keep]
            if not len(first):
                continue
            p, f = place[first], owner[first]
            back, ahead = p - first, last - first
            shape = (back * (WIDTH + 1) + ahead).astype(np.uint64)
            reach = mix(span[first] * np.uint64(0xFF51AFD7ED558CCD) + mix(span[last] + shape * np.uint64(0x9E3779B97F4A7C15)))
            start = first + lo - offsets[f]
            # Within a file each reach is given once, with its starts as runs of consecutive places (fill gives long ones).
            order = np.lexsort((start, reach, f))
            f, reach, start, back, ahead, a = f[order], reach[order], start[order], back[order], ahead[order], gram[p][order]
            group = np.r_[True, (f[1:] != f[:-1]) | (reach[1:] != reach[:-1])]
            run = group | np.r_[True, start[1:] != start[:-1] + 1]
            runs, groups = np.flatnonzero(run), np.flatnonzero(group)
            count = np.diff(np.r_[runs, len(start)])
            lists = pa.array(np.r_[np.searchsorted(runs, groups), len(runs)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[f[groups]]),
                    pa.array(a[groups].view(np.int64)),
                    pa.array(reach[groups].view(np.int64)),
                    pa.array(back[groups].astype(np.int32)),
                    pa.array(ahead[groups].astype(np.int32)),
                    pa.ListArray.from_arrays(lists, pa.array(start[runs].astype(np.int32))),
                    pa.ListArray.from_arrays(lists, pa.array(count.astype(np.int32))),
                ],
                names=["file_id", "anchor", "reach", "back", "ahead", "starts", "repeats"],
            )


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts: the row of each window, its place in the row, and its hash."""
    col = table.column("bytes").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    offsets, data = binary_parts(col)
    span = rolling_hashes(data[offsets[0] : offsets[-1]], (LEAST,))[LEAST]
    n = np.maximum(np.diff(offsets) - LEAST + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    rel = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, rel, span[offsets[row] - offsets[0] + rel]


def _extended(table: pa.Table) -> pa.RecordBatch:
    """Of all contexts of some anchors: the parts of each one-file reach that another file has too."""
    row, rel, h = _windows(table)
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    order = np.argsort(h, kind="stable")
    hs, r = h[order], row[order]
    start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(hs)])
    both = np.minimum.reduceat(lo[r], start) < np.maximum.reduceat(hi[r], start) if len(hs) else np.zeros(0, bool)
    shared = np.zeros(len(h), dtype=bool)
    shared[order] = np.repeat(both, size)
    shared &= (lo == hi)[row]
    at = np.flatnonzero(shared)
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    rows = row[at[first]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(table.column("anchor").to_numpy()[rows]),
            pa.array(table.column("reach").to_numpy()[rows]),
            pa.array(rel[at[first]].astype(np.int32)),
            pa.array((rel[at[last]] - rel[at[first]] + LEAST).astype(np.int32)),
        ],
        names=["anchor", "reach", "rel", "length"],
    )


def _extend_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor: whole groups are compared, some thousands of contexts at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for rb in batches:
        if not rb.num_rows:
            continue
        anchor = rb.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(anchor, anchor[-1]))  # where the last, perhaps unfinished, group begins
        if rows + cut >= 2000 and (cut or (held and held[-1].column(0)[-1].as_py() != anchor[0])):
            yield _extended(pa.Table.from_batches([*held, rb.slice(0, cut)]))
            held, rows, rb = [], 0, rb.slice(cut)
        held.append(rb)
        rows += rb.num_rows
    if held:
        yield _extended(pa.Table.from_batches(held))


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for a in range(0, rb.num_rows, 2000):
            t = pa.Table.from_batches([rb.slice(a, 2000)])
            row, rel, h = _windows(t)
            cols = [t.column(c).to_numpy()[row] for c in ("anchor", "reach", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, cols), pa.array(rel.astype(np.int32))], names=["window", "anchor", "reach", "lo", "hi", "rel"])


def shared_spans(files: DataFrame, ident: str = "file_id", data: str = "file_data", hot: int = 2000) -> DataFrame:
    """(file_id, span_start, span_bytes): the longest unbroken runs of bytes that lie in runs of 256 or more bytes which
    another file has too, at any position.

    Bytes repeated only within one file are not shared. Rows with equal ids are one file. Null, empty and short data has no
    spans; a null id is no file; copies are shared from end to end. An empty table gives no rows; extra columns don't matter.

    Scale: one row for about 97 bytes of data is shuffled; only anchors of two or more files go on; only contexts of
    anchors with unequal reaches (a few percent) fetch their bytes, up to 448 each. An anchor with more than `hot` distinct
    reaches isn't compared in one task: its windows are grouped by hash over all tasks instead, with the same result.
    """
    rows = files.filter(F.col(ident).isNotNull() & (F.octet_length(F.col(data)) >= LEAST)).select(F.col(ident).cast("long").alias("file_id"), F.col(data).alias("file_data"))
    seeds = stage(rows.mapInArrow(_seed_batches, _SEEDS), "seeds")
    several = seeds.groupBy("anchor").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi")).filter("lo < hi").select("anchor")
    live = stage(seeds.join(merged(several), "anchor"), "live")
    kinds = stage(
        live.groupBy("anchor", "reach").agg(
            F.min("file_id").alias("lo"),
            F.max("file_id").alias("hi"),
            F.min(F.struct("file_id", F.col("starts")[0].alias("start"), "ahead")).alias("one"),
        ),
        "kinds",
    )
    places = lambda df: df.select("*", F.explode(F.arrays_zip("starts", "repeats")).alias("at"))
    equal = places(live.join(merged(kinds.filter("lo < hi").select("anchor", "reach")), ["anchor", "reach"])).select(
        "file_id", F.col("at.starts").cast("long").alias("a"), (F.col("at.starts") + F.col("at.repeats") - 1 + F.col("ahead") + LEAST).cast("long").alias("b")
    )
    unequal = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("lo") == F.col("hi")).alias("open")).filter("n > 1 and open").select("anchor", "n")
    # Where each context is; its bytes are taken in the scan, if the places can be broadcast, else files are shuffled to them.
    wanted = stage(kinds.join(merged(unequal), "anchor").select("anchor", "reach", "lo", "hi", "n", "one.*"), "wanted")
    around = stage(
        rows.join(fitted(wanted, 50_000, "shuffle_hash"), "file_id")
        .select("anchor", "reach", "lo", "hi", "n", F.substring(F.col("file_data"), F.col("start") + 1, F.col("ahead") + LEAST).alias("bytes")),
        "around",
    )
    found = "anchor long, reach long, rel int, length int"
    few = around.filter(F.col("n") <= hot).drop("n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_extend_sorted, found)
    windows = around.filter(F.col("n") > hot).drop("n").mapInArrow(_window_batches, "window long, anchor long, reach long, lo long, hi long, rel int")
    twice = windows.groupBy("window").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l < h").select("window")
    many = windows.filter("lo = hi").join(merged(twice), "window").select("anchor", "reach", "rel", F.lit(LEAST).alias("length"))
    extended = places(live.join(merged(few.unionByName(many)), ["anchor", "reach"])).select(
        "file_id", (F.col("at.starts") + F.col("rel")).cast("long").alias("a"), (F.col("at.starts") + F.col("at.repeats") - 1 + F.col("rel") + F.col("length")).cast("long").alias("b")
    )
    return unbroken(equal.unionByName(extended))


def unbroken(pieces: DataFrame) -> DataFrame:
    """Overlapping and touching [a, b) of each file become one span."""
    w = Window.partitionBy("file_id").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("new", F.when(F.col("a") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("file_id", "island").agg(F.min("a").alias("span_start"), (F.max("b") - F.min("a")).alias("span_bytes")).select("file_id", "span_start", "span_bytes")


def shared_shares(files: DataFrame, ident: str = "file_id", data: str = "file_data") -> DataFrame:
    """(file_id, data_bytes, spans, shared_bytes, share) of every file; without data all is 0 and share is null."""
    spans = shared_spans(files, ident, data).groupBy("file_id").agg(F.count(F.lit(1)).alias("spans"), F.sum("span_bytes").alias("shared_bytes"))
    sizes = files.filter(F.col(ident).isNotNull()).groupBy(F.col(ident).cast("long").alias("file_id")).agg(F.max(F.coalesce(F.octet_length(F.col(data)), F.lit(0))).cast("long").alias("data_bytes"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return sizes.join(merged(spans), "file_id", "left").select("file_id", "data_bytes", zero("spans"), zero("shared_bytes"), (F.coalesce("shared_bytes", F.lit(0)) / F.nullif("data_bytes", F.lit(0))).alias("share"))
