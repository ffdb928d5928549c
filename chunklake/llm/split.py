"""Splitting oversized items at natural boundaries (problem 2).

Items are cut into byte ranges with halos; workers find boundaries in ranges, the boundary tables of an item are stitched in
order and turned into piece lengths, whose prefix sums give each piece's offset, and pieces are taken from the range they start
in. No step needs an item as a whole: rows of a table are ranged where they are read, files on disk by a source that reads ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklake.llm.bytesets import binary_parts
from chunklake.session import merged
from chunklake.sources.ranges import file_ranges

FILE_LIMIT, CHUNK_LIMIT, OVERLAP = 8192, 1024, 64
RANGE, HALO = 1 << 18, 2048
#: A CD sector's length and sync field.
SECTOR = 2352
SYNC = bytes([0] + [255] * 10 + [0])
#: Kinds of ends, weakest first; of the ends in reach the strongest kind wins, and of its ends the last.
ENDS = ("none", "word", "record", "sentence", "line", "fill", "sector")
_WORD, _RECORD, _SENTENCE, _LINE, _FILL, _SECTOR = range(1, 7)
_BLOCK = 1024
_FILL_RUN = 16


def _text_mask(d: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a stretch of text: about 97 % of the 256 bytes around it are printable or UTF-8 parts."""
    plain = (d >= 32) & (d != 127) | (d == 9) | (d == 10) | (d == 13)
    ascii_ = plain & (d < 128)
    width = min(256, len(d))
    total = lambda m: np.r_[0, np.cumsum(m)]
    lo = np.clip(np.arange(len(d)) - width // 2, 0, len(d) - width)
    p, a = total(plain), total(ascii_)
    return (p[lo + width] - p[lo] >= 0.97 * width) & (a[lo + width] - a[lo] >= 0.25 * width)


def _periods(blocks: np.ndarray) -> np.ndarray:
    """For each block (a row) the shortest period at which many of its bytes repeat, 0 if none."""
    best, share = np.zeros(len(blocks), np.int64), np.zeros(len(blocks))
    for p in range(4, min(129, blocks.shape[1] // 6)):
        s = (blocks[:, p:] == blocks[:, :-p]).mean(axis=1)
        better = s > np.maximum(0.35, share * 1.15)
        best[better], share[better] = p, s[better]
    return best


def _record_starts(block: np.ndarray, period: int) -> np.ndarray:
    """Places in a block where records of `period` bytes begin: with the longest run of columns that stay the same (where all do,
    at the block's own phase 0)."""
    rows = len(block) // period
    cols = block[: rows * period].reshape(rows, period)
    same = (cols[1:] == cols[:-1]).mean(axis=0) > 0.7
    phase = 0
    if same.any() and not same.all():
        twice = np.r_[same, same].astype(int)
        edge = np.diff(np.r_[0, twice, 0])
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        phase = int(a[np.argmax(b - a)]) % period
    return np.arange(phase, len(block), period)


def _records(d: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The record starts of the blocks that begin at `starts`; the whole blocks are searched together."""
    out = []
    whole = starts[starts + _BLOCK <= len(d)]
    for some in (whole, starts[len(whole) :]):
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            blocks = [d[a : a + _BLOCK] for a in part]
            if len(blocks[0]) < 64:
                continue
            for a, block, period in zip(part, blocks, _periods(np.stack(blocks))):
                if period:
                    out.append(_record_starts(block, int(period)) + a)
    return out


def boundaries(d: np.ndarray, first: int, whole: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """All ends within [lo, hi) of an item of `whole` bytes, of which d holds the bytes from `first` on: places and kinds.

    A place is where a piece may end, that is the next byte's offset; of several kinds at one place the strongest is given.
    """
    found: list[tuple[np.ndarray, int]] = []
    text = _text_mask(d) if len(d) else np.zeros(0, bool)
    if text.any():
        nl = np.flatnonzero((d == 10) & text)
        found.append((nl + 1, _LINE))
        stop = np.flatnonzero(((d[:-1] == 46) | (d[:-1] == 33) | (d[:-1] == 63)) & ((d[1:] == 32) | (d[1:] == 10)) & text[:-1])
        found.append((stop + 2, _SENTENCE))
        found.append((np.flatnonzero((d == 32) & text) + 1, _WORD))
    change = np.flatnonzero(d[1:] != d[:-1]) + 1 if len(d) else np.zeros(0, np.int64)
    if len(d):
        runs = np.diff(np.r_[0, change])
        # A letter repeated in a text is no fill.
        found.append((change[(runs >= _FILL_RUN) & ~text[change - 1]], _FILL))
    raw = d.tobytes()
    at, syncs = raw.find(SYNC), []
    while at >= 0:
        syncs.append(at)
        at = raw.find(SYNC, at + len(SYNC))
    found.append((np.array(syncs, dtype=np.int64), _SECTOR))
    if whole % SECTOR == 0 and not text.any():
        grid = np.arange(-(-first // SECTOR) * SECTOR, first + len(d), SECTOR) - first
        found.append((grid, _SECTOR))
    # Blocks have fixed places in the item, so that neighbouring ranges see the same records.
    starts = np.arange(max(0, (lo - first) // _BLOCK * _BLOCK), len(d), _BLOCK)
    if len(starts):
        prose = np.logical_or.reduceat(text, starts)
        found += [(x, _RECORD) for x in _records(d, starts[~prose])]
    place = np.concatenate([p for p, _ in found]) + first if found else np.zeros(0, np.int64)
    kind = np.concatenate([np.full(len(p), k) for p, k in found]) if found else np.zeros(0, np.int64)
    keep = (place >= lo) & (place < hi) & (place > 0) & (place < whole)
    place, kind = place[keep], kind[keep]
    order = np.lexsort((kind, place))
    place, kind = place[order], kind[order]
    last = np.r_[place[1:] != place[:-1], True] if len(place) else np.zeros(0, bool)
    return place[last], kind[last]


def useful(place: np.ndarray, kind: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends without those that can't be chosen by any cut, so that tables stay small: an end between two stronger ones that
    lie at most `window` apart, where each cut's choice is made among the ends of at least `window` bytes."""
    keep = np.ones(len(place), dtype=bool)
    for k in np.unique(kind)[:-1]:
        strong, at = place[kind > k], np.flatnonzero(kind == k)
        i = np.searchsorted(strong, place[at])
        inner = (i > 0) & (i < len(strong))
        keep[at[inner]] = strong[i[inner]] - strong[i[inner] - 1] > window
    return place[keep], kind[keep]


def choose_cuts(place: np.ndarray, kind: np.ndarray, whole: int, limit: int, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """How many bytes each piece adds to those before it, and the kind of its end: from each cut on, the strongest kind in the later half of what the limit
    allows, else in the earlier half, else the limit itself. The last piece ends with the item."""
    added, kinds = [], []
    step = limit - overlap
    base = 0
    while True:
        reach = base + (limit if base == 0 else step)
        if whole <= reach:
            added.append(whole - base)
            kinds.append(0)
            return added, kinds
        cut, what = reach, 0
        middle = base + (reach - base) // 2
        for a, b in ((middle, reach), (base, middle)):
            i, j = np.searchsorted(place, [a, b], side="right")
            if j > i:
                what = int(kind[i:j].max())
                cut = int(place[i:j][kind[i:j] == what][-1])
                break
        # A piece shorter than the overlap would repeat more than it adds.
        if cut - base <= overlap:
            cut, what = reach, 0
        added.append(cut - base)
        kinds.append(what)
        base = cut


def _find(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            num = [rb.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)]  # range_no, from, whole, item_limit
            offsets, data = binary_parts(rb.column(7))
            places, kinds, sizes = [], [], [0]
            for i in range(rb.num_rows):
                r, first, whole, limit = (int(c[i]) for c in num)
                p, k = boundaries(data[offsets[i] : offsets[i + 1]], first, whole, r * range_bytes, min(whole, (r + 1) * range_bytes))
                # An item of one range has its lengths at once; of others the ranges' tables go on to be stitched.
                p, k = choose_cuts(p, k, whole, limit) if whole <= range_bytes else useful(p, k, (limit - OVERLAP) // 2)
                places.append(np.asarray(p, dtype=np.int64))
                kinds.append(np.asarray(k, dtype=np.int8))
                sizes.append(len(p))
            lists = pa.array(np.cumsum(sizes).astype(np.int32))
            flat = lambda xs, t: pa.ListArray.from_arrays(lists, pa.array(np.concatenate(xs) if xs else np.zeros(0, t), t))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in (0, 1, 2, 3, 5, 6)), flat(places, pa.int64()), flat(kinds, pa.int8())], names=["item_kind", "item_id", "digest", "range_no", "whole", "item_limit", "place", "kind"])

    return run


def _stitch(range_bytes: int):
    """Ranges sorted by item and number: an item's tables, one after the other, give its pieces' lengths, and prefix sums their ends."""
    schema = pa.schema([("item_kind", pa.string()), ("item_id", pa.int64()), ("digest", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, parts, before = None, [], None

        def laid() -> tuple:
            place, kind = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            added, kinds = (place, kind) if item[3] <= range_bytes else choose_cuts(place, kind, item[3], item[4])
            ends = np.cumsum(added)
            starts = np.r_[0, ends[:-1] - OVERLAP]
            return (*item[:3], starts, ends, np.asarray(kinds, dtype=np.int8))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for rb in batches:
            out = []
            cols = [rb.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 3)]
            for i, (*key, range_no) in enumerate(zip(*cols)):
                if key != item:
                    if item is not None:
                        out.append(laid())
                    item, parts, before = key, [], None
                # Rows repeated with equal id and data have equal ranges, which follow each other.
                if range_no != before:
                    parts.append(tuple(rb.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (6, 7)))
                before = range_no
            if out:
                yield batch(out)
        if item is not None:
            yield batch([laid()])

    return run


def _ranges(items: DataFrame, range_bytes: int, left: int, right: int | Column) -> DataFrame:
    """Byte ranges of items over the limit, with halos. The slices are made inside one expression: the item isn't copied for each."""
    n = F.octet_length("data")
    cut = F.transform(
        F.sequence(F.lit(0), F.expr(f"(octet_length(data) - 1) div {range_bytes}").cast("int")),
        lambda r: F.struct(
            r.alias("range_no"),
            F.greatest(r * range_bytes - left, F.lit(0)).cast("long").alias("from"),
            F.col("data").substr(F.greatest(r * range_bytes - left, F.lit(0)) + 1, F.least(r * range_bytes, F.lit(left)) + range_bytes + right).alias("bytes"),
        ),
    )
    return (
        items.filter(n > F.col("item_limit"))
        .select("item_kind", "item_id", F.xxhash64("data").alias("digest"), "item_limit", n.cast("long").alias("whole"), cut.alias("cut"))
        .select("item_kind", "item_id", "digest", "item_limit", "whole", F.explode("cut").alias("r"))
        .select("item_kind", "item_id", "digest", "r.range_no", "r.from", "whole", "item_limit", "r.bytes")
    )


def _file_ranges(spark: SparkSession, paths: list[str], limit: int, range_bytes: int, left: int, right: int) -> DataFrame:
    """The same rows for files on disk, none of which is read as a whole; item_id is the path's hash, digest that of path and size."""
    r = file_ranges(spark, paths, range_bytes, left, right).filter(F.col("size") > limit)
    ident = F.xxhash64("path")
    return r.select(F.lit("file").alias("item_kind"), ident.alias("item_id"), F.xxhash64("path", "size").alias("digest"), "range_no", "from", F.col("size").alias("whole"), F.lit(limit).alias("item_limit"), "bytes")


def items_of(files: DataFrame | None = None, chunks: DataFrame | None = None, file_limit: int = FILE_LIMIT, chunk_limit: int = CHUNK_LIMIT) -> DataFrame:
    """(item_kind, item_id, data, item_limit) of both tables; the claimed sizes are not used."""
    parts = []
    for df, kind, ident, data, limit in ((files, "file", "file_id", "file_data", file_limit), (chunks, "chunk", "msg_id", "chunk_data", chunk_limit)):
        if df is not None:
            parts.append(df.select(F.lit(kind).alias("item_kind"), F.col(ident).cast("long").alias("item_id"), F.col(data).alias("data"), F.lit(limit).alias("item_limit")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


_KEY = ["item_kind", "item_id", "digest"]


def _plan(ranges: DataFrame, range_bytes: int) -> DataFrame:
    found = ranges.mapInArrow(_find(range_bytes), "item_kind string, item_id long, digest long, range_no int, whole long, item_limit int, place array<long>, kind array<byte>")
    # digest spreads the items, and all ranges of one item meet in one task: its lengths, or some bytes for each useful end, not the data.
    sorted_ = found.repartition(*_KEY).sortWithinPartitions(*_KEY, "range_no")
    return sorted_.mapInArrow(_stitch(range_bytes), "item_kind string, item_id long, digest long, starts array<long>, ends array<long>, kinds array<byte>")


def split_plan(items: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(item_kind, item_id, digest, starts, ends, kinds) of the items over their limit: where the pieces begin and end, and at what.

    Items of exactly the limit, shorter, empty or null ones are not split and not in the result. Rows repeated with equal id
    and data are one item; with equal id and other data they are several (digest tells them apart). A null id is kept.
    """
    return _plan(_ranges(items, range_bytes, HALO, HALO), range_bytes)


def _cut(plan: DataFrame, ranges: DataFrame, range_bytes: int) -> DataFrame:
    """The pieces of a plan, each from the range it starts in; ranges reach beyond their end by the limit."""
    placed = (
        plan.select(*_KEY, F.posexplode(F.arrays_zip("starts", "ends", "kinds")).alias("piece_no", "p"))
        .select(*_KEY, "piece_no", F.col("p.starts").alias("piece_start"), F.col("p.ends").alias("piece_end"), F.col("p.kinds").alias("kind"))
        .withColumn("range_no", F.expr(f"piece_start div {range_bytes}").cast("int"))
    )
    p, r = placed.alias("p"), merged(ranges.dropDuplicates([*_KEY, "range_no"])).alias("r")
    got = p.join(r, [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*_KEY, "range_no")])
    size = F.col("p.piece_end") - F.col("p.piece_start")
    return got.select(
        *[F.col(f"p.{c}") for c in _KEY],
        "p.piece_no",
        "p.piece_start",
        size.alias("piece_bytes"),
        "p.piece_end",
        F.array(*[F.lit(x) for x in ENDS])[F.col("p.kind").cast("int")].alias("ended_at"),
        F.col("r.bytes").substr((F.col("p.piece_start") - F.col("r.from") + 1).cast("int"), size.cast("int")).alias("piece"),
    )


def pieces(items: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(item_kind, item_id, digest, piece_no, piece_start, piece_bytes, piece_end, ended_at, piece) of the items over their limit.

    piece_start counts bytes from 0; a piece after the first starts OVERLAP bytes before the last one's end, so that it
    begins with the last 64 bytes of the one before. `ended_at` names the kind of end, "none" for the item's own end or where
    the content has no end in reach. Cases as in split_plan.
    """
    ranges = _ranges(items, range_bytes, 0, F.col("item_limit")).select(*_KEY, "range_no", "from", "bytes")
    return _cut(split_plan(items, range_bytes), ranges, range_bytes)


def pieces_of_files(spark: SparkSession, paths: list[str], limit: int = FILE_LIMIT, range_bytes: int = RANGE) -> DataFrame:
    """The same for files on disk of any size (folders are listed, not walked): tasks read ranges, once to find ends and once to cut."""
    plan = _plan(_file_ranges(spark, paths, limit, range_bytes, HALO, HALO), range_bytes)
    return _cut(plan, _file_ranges(spark, paths, limit, range_bytes, 0, limit).select(*_KEY, "range_no", "from", "bytes"), range_bytes)


def oversized(items: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(item_kind, item_id) of the items that come out as two or more pieces."""
    return split_plan(items, range_bytes).filter(F.size("ends") > 1).select("item_kind", "item_id").distinct()
