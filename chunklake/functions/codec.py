"""Codecs: zstd with a dictionary, and a lossless codec for CD audio; one compressor is kept for each Python worker."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DEFAULT_LEVEL = 19
#: Trial runs use at least this level.
TRIAL_LEVEL = 7


@functools.lru_cache(maxsize=8)
def _compressor(dictionary: bytes, level: int):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)


@functools.lru_cache(maxsize=8)
def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def compress(data: bytes, dictionary: bytes = b"", level: int = DEFAULT_LEVEL) -> bytes:
    return _compressor(dictionary, level).compress(data)


def decompress(data: bytes, dictionary: bytes = b"") -> bytes:
    """Also reads frames that don't say their size."""
    return _decompressor(dictionary).decompressobj().decompress(data)


def with_codec(df: DataFrame, column: str, out: str, how: str, dictionary: bytes = b"", level: int = DEFAULT_LEVEL) -> DataFrame:
    """Adds `out`: `column` compressed or decompressed (binary), or its compressed length (how = "length"). Null stays null.
    "stored" decodes by the column codec: 0 zstd, 1 audio."""
    shared = df.sparkSession.sparkContext.broadcast(dictionary)  # at most 1 MiB by its trainer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        do = {"compress": lambda x: compress(x, d, level), "length": lambda x: len(compress(x, d, level)), "decompress": lambda x: decompress(x, d), "audio": encode_audio, "unaudio": decode_audio, "stored": None}[how]
        kind = pa.int64() if how == "length" else pa.binary()
        for rb in batches:
            i = rb.schema.get_field_index(column)
            vals = rb.column(i).to_pylist()
            if how == "stored":
                codecs = rb.column(rb.schema.get_field_index("codec")).to_pylist()
                got = pa.array([None if v is None else decode_audio(v) if c else decompress(v, d) for v, c in zip(vals, codecs)], kind)
            else:
                got = pa.array([None if v is None else do(v) for v in vals], kind)
            yield pa.RecordBatch.from_arrays([*rb.columns, got], names=[*rb.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` {'bigint' if how == 'length' else 'binary'}")


def train(samples: list[bytes], size: int, optimise: bool = False, threads: int = 0) -> bytes:
    """A dictionary of at most `size` bytes from bounded samples; empty where there is too little to train on."""
    if len(samples) < 8 or sum(map(len, samples)) < 2 * size:
        return b""
    try:
        d = zstandard.train_dictionary(size, samples, steps=4, threads=threads) if optimise else zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return b""
    return d.as_bytes()


def _predict(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.diff(x, prepend=x.dtype.type(0))
    return x


def encode_audio(pcm: bytes, level: int = 9) -> bytes:
    """Losslessly packs 16-bit little-endian stereo: mid and side, the best fixed difference order of 0 to 4 for each, folded to
    unsigned, bytes apart, zstd. Bytes that are no whole frames are kept after it. Empty gives one byte."""
    whole = len(pcm) // 4 * 4
    frames = np.frombuffer(pcm[:whole], "<i2").reshape(-1, 2).astype(np.int64)
    left, right = frames[:, 0], frames[:, 1]
    side = left - right
    mid = (left + right) >> 1
    head, body = bytearray([len(pcm) - whole]), []
    for ch in (mid, side):
        order, res = min(((o, _predict(ch, o)) for o in range(5)), key=lambda t: int(np.abs(t[1]).sum()))
        head.append(order)
        body.append(np.where(res >= 0, 2 * res, -2 * res - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if len(res) else b"")
    raw = len(frames).to_bytes(4, "little") + b"".join(body)
    return bytes(head) + pcm[whole:] + compress(raw, b"", level)


def decode_audio(data: bytes) -> bytes:
    rest, orders = data[0], data[1:3]
    raw = decompress(data[3 + rest :])
    n = int.from_bytes(raw[:4], "little")
    chans = []
    for i, o in enumerate(orders):
        u = np.frombuffer(raw[4 + 4 * n * i : 4 + 4 * n * (i + 1)], np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64) if n else np.zeros(0, np.int64)
        x = np.where(u & 1, -((u + 1) >> 1), u >> 1)
        for _ in range(o):
            x = np.cumsum(x)
        chans.append(x)
    mid, side = chans
    left = mid + ((side + (side & 1)) >> 1)
    right = left - side
    return np.stack([left, right], 1).astype("<i2").tobytes() + data[3 : 3 + rest]


def trial_size(chunks: DataFrame, data: str, dictionary: bytes, level: int) -> int:
    """Dictionary plus compressed bytes of all chunks; the level is at least 7."""
    got = with_codec(chunks.select(data), data, "n", "length", dictionary, max(level, TRIAL_LEVEL)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return len(dictionary) + int(got)
