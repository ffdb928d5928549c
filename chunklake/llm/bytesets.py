"""Hashes over binary columns, computed on the Arrow buffers of a batch without copying single values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def mix(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of a fresh array in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def rolling_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of the given lengths (powers of two), by doubling; each step mixes, so that none is linear."""
    h = mix((data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    size, got = 1, {}
    while True:
        if size in sizes:
            got[size] = h
        if size >= max(sizes):
            return got
        if len(h) > size:
            wide = h[:-size] * np.uint64(0xFF51AFD7ED558CCD)
            wide += h[size:]
            h = mix(wide)
        else:
            h = h[:0]
        size *= 2


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a binary array; null rows are empty."""
    wide = pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return off, data


def stretches(offsets: np.ndarray, least: int, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of the bytes, about `limit` long, such that each window of `least` bytes lies whole in one of them
    and starts in one only (a window starts in [lo, hi - least]). Files follow each other; a longer file is cut with a halo."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        size = offsets[i + 1] - offsets[i]
        if size > limit:
            for a in range(int(offsets[i]), int(offsets[i + 1]) - least + 1, limit):
                yield a, int(min(offsets[i + 1], a + limit + least - 1))
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = max(i + 1, min(j, n))
        if offsets[j] - offsets[i] >= least:
            yield int(offsets[i]), int(offsets[j])
        i = j
