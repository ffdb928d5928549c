"""Settings: a TOML file, command-line values over it, and their checks."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

from chunklake.functions.scalars import parse_size

TEMPLATE = """# Settings of chunklake; values given on the command line come first.
# window = "2KiB"
# dictionary = "16KiB"
# dictionary_sample = "64MiB"
# level = 19
# hash_bits = 64
# normalisation = 0
# auto_tune = false
# tune_timeout = 15
# optimise_dictionary = false
# optical = false
# force = false
# json = false
# threads = 0
# log_days = 7
"""


@dataclass(frozen=True)
class Settings:
    window: int | None = None
    dictionary: int | None = None
    dictionary_sample: int = 64 << 20
    level: int = 19
    hash_bits: int = 64
    normalisation: int = 0
    auto_tune: bool = False
    tune_timeout: float = 15.0
    optimise_dictionary: bool = False
    optical: bool = False
    force: bool = False
    json: bool = False
    threads: int = 0
    log_days: int = 7

    def sizes(self) -> tuple[int, int]:
        """(window, dictionary): 2 KiB and 16 KiB, for discs 8 KiB and 128 KiB, where not set."""
        return self.window or (8192 if self.optical else 2048), self.dictionary or (131072 if self.optical else 16384)

    def checked(self) -> Settings:
        window, dictionary = self.sizes()
        if window < 256 or window & (window - 1):
            raise ValueError("window: a power of two from 256 on")
        if not 0 < dictionary <= 1 << 20:
            raise ValueError("dictionary: up to 1 MiB")
        if not 0 < self.dictionary_sample <= 4 << 30:
            raise ValueError("dictionary_sample: up to 4 GiB")
        if not 1 <= self.level <= 22:
            raise ValueError("level: 1 to 22")
        if self.hash_bits not in (64, 128):
            raise ValueError("hash_bits: 64 or 128")
        if self.auto_tune and (self.window or self.dictionary):
            raise ValueError("auto_tune finds window and dictionary itself")
        if self.auto_tune and self.optical:
            raise ValueError("auto_tune is not for discs")
        return self


def load(path: str, create: bool = True) -> Settings:
    """Settings of a file; a missing one is created with commented defaults."""
    if not os.path.exists(path):
        if create:
            with open(path, "w") as f:
                f.write(TEMPLATE)
        return Settings()
    with open(path, "rb") as f:
        got = tomllib.load(f)
    known = {x.name for x in fields(Settings)}
    if unknown := set(got) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return merge(Settings(), got)


def merge(base: Settings, given: dict) -> Settings:
    """base with the values that aren't None; sizes may be text as `2KiB`."""
    some = {k: parse_size(v) if k in ("window", "dictionary", "dictionary_sample") and isinstance(v, str) else v for k, v in given.items() if v is not None}
    return replace(base, **some)
