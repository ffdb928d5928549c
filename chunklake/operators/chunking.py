"""Chunking: content-defined (gear hash, normalised) through Arrow, fixed blocks and run blocks natively."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunklake.functions.hashing import CHUNK_SEED, chunk_hash, hash_hex
from chunklake.operators.concat import groups, keyed
from chunklake.session import merged, stage
from chunklake.sources.ranges import file_ranges, filesystem

AUDIO_BLOCK_SECTORS = 16
SECTOR_BYTES = 2352
CHUNK_SCHEMA = "chunk_no int, chunk_offset long, chunk_length int, chunk_hash string, chunk_data binary"


def gear_table(seed: int = CHUNK_SEED) -> np.ndarray:
    """256 random words from a rule: the first eight bytes of the MD5 of each byte value, with the seed mixed in by XOR."""
    words = [int.from_bytes(hashlib.md5(bytes([i])).digest()[:8], "big") for i in range(256)]
    return np.array(words, dtype=np.uint64) ^ np.uint64(seed)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 64 bytes that end there: sum of table[b] << age. Made in six doublings over arrays."""
    h, span = table[data], 1
    while span < 64 and span < len(h):
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint64(span)
        h = h + older
        span *= 2
    return h


def spread_mask(bits: int) -> int:
    """A mask of so many ones, spread evenly over the upper 48 bits, so that a cut depends on about the last 64 bytes."""
    return sum(1 << (63 - 48 * i // bits) for i in range(bits))


#: The gear hash of the first bytes after a restart, as a product: row m sums the bytes up to m, each shifted by its age.
_YOUNG = 63
_RESTART = np.array([[1 << (m - j) if j <= m else 0 for j in range(_YOUNG)] for m in range(_YOUNG)], dtype=np.uint64)


@dataclass(frozen=True)
class Rule:
    """How a file is cut: chunks of at least window/4 and at most 4 * window bytes, but for the last.

    The gear hash starts anew window/4 bytes into each chunk. A chunk ends before the first byte with which the hash has zeros
    where a mask has ones: log2(window) + level ones up to the wanted size, log2(window) - level beyond it; without such a byte it ends at the
    largest size. Level 0 uses one mask.
    """

    window: int = 2048
    level: int = 0
    seed: int = CHUNK_SEED

    def __post_init__(self):
        if self.window < 256 or self.window & (self.window - 1):
            raise ValueError("the window is a power of two of at least 256 bytes")

    @property
    def least(self) -> int:
        return self.window // 4

    @property
    def most(self) -> int:
        return self.window * 4

    @property
    def masks(self) -> tuple[np.uint64, np.uint64]:
        bits = int(math.log2(self.window))
        return np.uint64(spread_mask(bits + self.level)), np.uint64(spread_mask(bits - self.level))

    @functools.cached_property
    def table(self) -> np.ndarray:
        return gear_table(self.seed)

    def candidates(self, data: np.ndarray, lead: int = 0, part: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Places where the hash of the last 64 bytes fits the first mask, and the second, from `lead` on; the 63 bytes before lead are its
        history. A large file is hashed in parts, so that memory doesn't grow with its size."""
        found: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for a in range(lead, len(data), part):
            old = min(a, 63)
            h = gear_hashes(data[a - old : a + part], self.table)[old:]
            for out, mask in zip(found, self.masks):
                out.append(np.flatnonzero((h & mask) == 0) + a)
        return np.concatenate(found[0]), np.concatenate(found[1])

    def resolve(self, n: int, strict: np.ndarray, loose: np.ndarray, read: Callable[[int, int], np.ndarray], base: int = 0, final: bool = True) -> list[int]:
        """Ends of the chunks of a file of n bytes from its candidates. The first 63 places after a restart have a shorter history than
        the candidates: there the bytes themselves, read(from, to), decide. Where the file isn't final, only what later bytes can't change."""
        cuts = []
        while n - base > self.least and (final or n - base >= self.most):
            start = base + self.least
            young = read(start, min(n, start + _YOUNG))
            h = _RESTART[: len(young), : len(young)] @ self.table[young]
            hit = np.flatnonzero((h & self.masks[0]) == 0)
            if len(hit):
                cut = start + int(hit[0])
            else:
                i = int(np.searchsorted(strict, start + _YOUNG))
                cut = int(strict[i]) if i < len(strict) and strict[i] < base + self.window else 0
                if not cut:
                    i = int(np.searchsorted(loose, max(start + _YOUNG, base + self.window)))
                    cut = int(loose[i]) if i < len(loose) and loose[i] < base + self.most else base + self.most
            if cut >= n:
                break
            cuts.append(cut)
            base = cut
        return [*cuts, n] if final and n else cuts


def cut_points(data: np.ndarray, window: int, level: int = 0, rule: Rule | None = None, final: bool = True) -> list[int]:
    """Ends of the chunks of one file. No data, no chunks."""
    rule = rule or Rule(window, level)
    return rule.resolve(len(data), *rule.candidates(data), lambda a, b: data[a:b], final=final) if len(data) else []


def content_chunks(files: DataFrame, data: str, keys: list[str], window: int = 2048, level: int = 0, bits: int = 64, seed: int = CHUNK_SEED, fold: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """One row for each chunk: the key columns, chunk_no, chunk_offset, chunk_length, chunk_hash, chunk_data.

    Null and empty data has no chunks (keep such files by a left join). No shuffle; the state is one file's. level is the
    normalisation level, 0 in the pipeline; bits is the hash width, 64 or 128. fold, if given, makes of each batch of rows the one that leaves the task.
    """
    rule = Rule(window, level, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            row, no, offset, length, hashes, parts, held = [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                names = [*keys, "chunk_no", "chunk_offset", "chunk_length", "chunk_hash", "chunk_data"]
                cols = [rb.column(k).take(pa.array(row, pa.int64())) for k in range(len(keys))]
                made = pa.RecordBatch.from_arrays([*cols, pa.array(no, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int32()), pa.array(hashes, pa.string()), pa.array(parts, pa.binary())], names=names)
                return fold(made) if fold else made

            for i, v in enumerate(rb.column(len(keys))):
                raw = v.as_py()
                if not raw:
                    continue
                base = 0
                for k, cut in enumerate(cut_points(np.frombuffer(raw, np.uint8), window, level, rule)):
                    piece = raw[base:cut]
                    for x, y in ((row, i), (no, k), (offset, base), (length, cut - base), (hashes, hash_hex(piece, bits, seed)), (parts, piece)):
                        x.append(y)
                    base = cut
                held += len(raw)
                if held > 16 << 20:
                    yield out()
                    row, no, offset, length, hashes, parts, held = [], [], [], [], [], [], 0
            yield out()

    picked = files.select(*keys, F.col(data).cast("binary").alias("data"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, {CHUNK_SCHEMA}")


def stream_chunks(parts: DataFrame, keys: list[str], order: str, data: str, window: int = 2048, level: int = 0, bits: int = 64, seed: int = CHUNK_SEED, held: int = 4 << 20) -> DataFrame:
    """The chunks of each key's parts, one after the other by `order`: as content_chunks, but a key's data is never one value.

    A task holds `held` bytes and a chunk: what later bytes can't change is cut and leaves, the rest waits for them.
    """
    rule = Rule(window, level, seed)
    source = keyed(parts, keys, order, data)
    schema = T.StructType([*(source.schema[k] for k in keys), *T.StructType.fromDDL(CHUNK_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = []

        def seen():
            for rb in batches:
                types[:] = [rb.schema.field(i).type for i in range(len(keys))]
                yield rb

        key, buffer, at, no, rows = None, bytearray(), 0, 0, []

        def cut(final: bool) -> None:
            nonlocal buffer, at, no
            base = 0
            for end in cut_points(np.frombuffer(bytes(buffer), np.uint8), window, level, rule, final):
                piece = bytes(buffer[base:end])
                rows.append((*key, no, at + base, len(piece), hash_hex(piece, bits, seed), piece))
                no, base = no + 1, end
            buffer, at = buffer[base:], at + base

        def batch() -> pa.RecordBatch:
            kinds = [*types, pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=schema.names)

        for k, values, begins in groups(seen(), len(keys)):
            if begins:
                if key is not None:
                    cut(True)
                key, buffer, at, no = k, bytearray(), 0, 0
            for v in values:
                buffer += v or b""
                if len(buffer) > held + rule.most:
                    cut(False)
            if len(rows) > 5000:
                yield batch()
                rows = []
        if key is not None:
            cut(True)
        if rows:
            yield batch()

    return source.mapInArrow(run, schema)


def chunks_of_files(spark: SparkSession, paths: list[str], window: int = 2048, level: int = 0, bits: int = 64, seed: int = CHUNK_SEED, range_bytes: int = 1 << 20) -> DataFrame:
    """(path, chunk_no, chunk_offset, chunk_length, chunk_hash, chunk_data) of files on disk of any size, with the cuts of content_chunks.

    Tasks hash ranges, each with the 63 bytes before it, for places where a chunk may end. Those of a file meet in one task, which reads 63
    bytes for each chunk and says where chunks end; then tasks cut and hash the chunks from the ranges they begin in. Empty files have none.
    """
    rule = Rule(window, level, seed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            strict, loose = [], []
            for no, first, raw in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist(), rb.column(4)):
                found = rule.candidates(np.frombuffer(raw.as_py(), np.uint8), no * range_bytes - first)
                for out, x in zip((strict, loose), found):
                    out.append(x + first)
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in range(3)), *(pa.array(x, pa.list_(pa.int64())) for x in (strict, loose))], names=["path", "size", "range_no", "strict", "loose"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, strict, loose = None, 0, [], []

        def ends() -> list[int]:
            own, inside = filesystem(now)
            with own.open_input_file(inside) as f:
                block, held = -1, b""

                def read(a: int, b: int) -> np.ndarray:
                    nonlocal block, held
                    if a >> 20 != block:
                        block = a >> 20
                        held = f.read_at(min(size, ((block + 1) << 20) + _YOUNG) - (block << 20), block << 20)
                    return np.frombuffer(held[a - (block << 20) : b - (block << 20)], np.uint8)

                return rule.resolve(size, np.concatenate(strict), np.concatenate(loose), read)

        def batch(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([e for _, e in done], pa.list_(pa.int64()))], names=["path", "ends"])

        for rb in batches:
            done = []
            for i, (path, n) in enumerate(zip(rb.column(0).to_pylist(), rb.column(1).to_pylist())):
                if path != now:
                    if now is not None:
                        done.append((now, ends()))
                    now, size, strict, loose = path, n, [], []
                strict.append(rb.column(3)[i].values.to_numpy(zero_copy_only=False))
                loose.append(rb.column(4)[i].values.to_numpy(zero_copy_only=False))
            if done:
                yield batch(done)
        if now is not None:
            yield batch([(now, ends())])

    found = file_ranges(spark, paths, range_bytes, 63, 0).mapInArrow(scan, "path string, size long, range_no int, strict array<long>, loose array<long>")
    cuts = stage(found.repartition("path").sortWithinPartitions("path", "range_no").mapInArrow(resolve, "path string, ends array<long>"), "cuts")
    starts = F.transform("ends", lambda e, i: F.struct(F.when(i > 0, F.element_at("ends", i)).otherwise(F.lit(0)).cast("long").alias("a"), e.alias("b")))
    each = cuts.select("path", F.posexplode(starts).alias("chunk_no", "c")).select("path", "chunk_no", F.col("c.a").alias("chunk_offset"), (F.col("c.b") - F.col("c.a")).cast("int").alias("chunk_length"))
    placed = each.withColumn("range_no", F.expr(f"cast(chunk_offset div {range_bytes} as int)"))
    ranges = merged(file_ranges(spark, paths, range_bytes, 0, rule.most).select("path", "range_no", "from", "bytes"))
    data = F.col("bytes").substr((F.col("chunk_offset") - F.col("from") + 1).cast("int"), F.col("chunk_length"))
    return placed.join(ranges, ["path", "range_no"]).select("path", "chunk_no", "chunk_offset", "chunk_length", data.alias("chunk_data")).withColumn("chunk_hash", chunk_hash(F.col("chunk_data"), bits, seed))


def fixed_blocks(df: DataFrame, data: Column, keys: list[str], size: int) -> DataFrame:
    """(keys, block_no, block_offset, block): blocks of `size` bytes (characters for text), the last one shorter. Native.

    The slices are made in one expression before the explode, so that no exploded row carries the whole value.
    """
    n = F.length(data)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.struct(i.cast("long").alias("no"), data.substr(i * size + 1, F.lit(size)).alias("b")))
    parts = df.select(*keys, F.when(n > 0, cut).alias("parts"))
    return parts.select(*keys, F.explode("parts").alias("p")).select(*keys, F.col("p.no").alias("block_no"), (F.col("p.no") * size).alias("block_offset"), F.col("p.b").alias("block"))


def run_blocks(runs: DataFrame, start: str, count: str, size: int = AUDIO_BLOCK_SECTORS, whole: Column | None = None) -> DataFrame:
    """Adds block_no, block_start and block_count to each run of sectors: blocks of `size`, restarting at each run, a short one last.
    Runs for which `whole` is true are one block."""
    width = F.when(whole, F.col(count)).otherwise(F.lit(size)) if whole is not None else F.lit(size)
    ahead = runs.filter(F.col(count) > 0).withColumn("_w", width.cast("long"))
    return (
        ahead.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / F.col("_w")).cast("long"))).alias("block_no"))
        .withColumn("block_start", F.col(start) + F.col("block_no") * F.col("_w"))
        .withColumn("block_count", F.least(F.col("_w"), F.col(count) - F.col("block_no") * F.col("_w")))
        .drop("_w")
    )


def sectors_of(files: DataFrame, data: str, keys: list[str]) -> DataFrame:
    """(keys, sector_idx, sector) of the 2,352-byte sectors of images; an incomplete one at the end is left out."""
    whole = files.filter(F.octet_length(data) >= SECTOR_BYTES)
    got = fixed_blocks(whole, F.col(data), keys, SECTOR_BYTES)
    return got.filter(F.octet_length("block") == SECTOR_BYTES).select(*keys, F.col("block_no").alias("sector_idx"), F.col("block").alias("sector"))
