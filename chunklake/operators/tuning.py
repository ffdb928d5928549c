"""Dictionary training, trial compression, and the two hill climbs over parameters."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.functions.codec import train, trial_size
from chunklake.operators.layout import strided_sample
from chunklake.session import fitted

FIRST_WINDOW, FIRST_DICTIONARY, MOST_DICTIONARY = 512, 8192, 1 << 20
#: Bytes that a dictionary is trained on, where not set: 64 MiB, or all if there are fewer. They reach the driver.
SAMPLE = 64 << 20


@dataclass(frozen=True)
class Trial:
    parameter: int
    size: int
    seconds: float


def dictionary(chunks: DataFrame, size: int, key: str = "chunk_hash", data: str = "chunk_data", optimise: bool = False, cap: int = SAMPLE) -> bytes:
    """A dictionary trained on all chunks, or where they are more than `cap` bytes on a strided sample of them in hash order.

    The cap (at most 4 GiB) is a setting, and holds at any corpus size; only the sample reaches the driver.
    """
    lengths = chunks.select(key, F.octet_length(data).cast("long").alias("length")).filter("length > 0")
    sample = strided_sample(lengths, cap, key, "length").select(key)
    rows = chunks.join(fitted(sample), key, "left_semi").orderBy(key).select(data).collect()
    return train([bytes(r[0]) for r in rows], size, optimise)


def climb(measure: Callable[[int], int], first: int, most: int, timeout: float | None = None) -> list[Trial]:
    """Doubles the parameter while the size doesn't grow (a tie goes on); stops at the first growth, beyond `most`, or after a
    trial that took longer than timeout."""
    trials: list[Trial] = []
    p = first
    while p <= most:
        began = time.monotonic()
        size = measure(p)
        trials.append(Trial(p, size, time.monotonic() - began))
        if len(trials) > 1 and size > trials[-2].size or timeout is not None and trials[-1].seconds > timeout:
            break
        p *= 2
    return trials


def best(trials: list[Trial]) -> Trial:
    """The last trial before the growth: of equals the later one."""
    return min(reversed(trials), key=lambda t: t.size)


def tune_dictionary(chunks: DataFrame, level: int = 7, timeout: float | None = None, data: str = "chunk_data", most: int = MOST_DICTIONARY) -> list[Trial]:
    """The dictionary size: 8 KiB, doubled up to 1 MiB."""
    return climb(lambda size: trial_size(chunks, data, dictionary(chunks, size, data=data), level), FIRST_DICTIONARY, most, timeout)


def tune_window(make_chunks: Callable[[int], DataFrame], largest_file: int, level: int = 7, timeout: float | None = None, dictionary_size: int = FIRST_DICTIONARY, data: str = "chunk_data") -> list[Trial]:
    """The chunk window: 512 bytes, doubled up to the largest file's size; make_chunks gives the unique chunks for a window."""

    def measure(window: int) -> int:
        chunks = make_chunks(window)
        return trial_size(chunks, data, dictionary(chunks, dictionary_size, data=data), level)

    return climb(measure, FIRST_WINDOW, max(FIRST_WINDOW, largest_file), timeout)
