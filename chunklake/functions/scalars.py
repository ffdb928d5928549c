"""Small scalar functions: disc positions, BCD, path parts, sizes, index lists. All native unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAMES, SECONDS = 75, 60


def msf_to_frames(m: Column, s: Column, f: Column) -> Column:
    return ((m * SECONDS + s) * FRAMES + f).cast("int")


def frames_to_msf(n: Column) -> Column:
    """STRUCT<m, s, f>; the minute wraps at 256, as a byte does."""
    n = n.cast("long")
    return F.struct(
        (F.floor(n / (SECONDS * FRAMES)) % 256).cast("int").alias("m"),
        (F.floor(n / FRAMES) % SECONDS).cast("int").alias("s"),
        (n % FRAMES).cast("int").alias("f"),
    )


def msf_text(msf: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", msf["m"], msf["s"], msf["f"])


def parse_msf(text: Column) -> Column:
    """Frames of mm:ss:ff; another form, seconds over 59 or frames over 74 raise an error; null gives null."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)$", i).cast("int")
    good = text.rlike(r"^\d+:\d+:\d+$") & (part(2) < SECONDS) & (part(3) < FRAMES)
    return F.when(text.isNull(), F.lit(None).cast("int")).when(good, msf_to_frames(part(1), part(2), part(3))).otherwise(F.raise_error(F.concat(F.lit("no mm:ss:ff time: "), text)).cast("int"))


def from_bcd(b: Column) -> Column:
    return F.shiftright(b, 4) * 10 + b.bitwiseAND(F.lit(15))


def to_bcd(n: Column) -> Column:
    return F.shiftleft(F.floor(n / 10).cast("int"), 4) + (n % 10).cast("int")


def base_name(path: Column) -> Column:
    """What follows the last separator, / or \\."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-case extension, empty without one; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    b = base_name(path)
    return F.when(b.rlike(r"^.+\.[^.]*$"), F.regexp_extract(b, r"^(.+)\.[^.]*$", 1)).otherwise(b)


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(stem(path), F.lit("." + ext))


def lossy_name(raw: Column) -> Column:
    """Bytes as UTF-8 text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(n: Column) -> Column:
    """A size with a unit of powers of 1024 and up to two decimals: 1536 gives 1.5 KB, 0 gives 0 B."""
    steps = []
    for i in range(len(UNITS) - 1, -1, -1):
        text = F.format_string("%.2f", F.round(n.cast("double") / float(1024**i), 2))
        short = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
        steps.append(F.when((n >= 1024**i) if i else n.isNotNull(), F.concat(short, F.lit(" " + UNITS[i]))))
    return F.coalesce(*steps)


_SIZE = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*([kmgt]?)(i?)b?\s*$", re.I)


def parse_size(text: str) -> int:
    """Bytes of `2kb`, `256K`, `64KiB`, `1.5 mb`: units are powers of 1024 with i or without b, of 1000 as kb, mb, gb, tb."""
    m = _SIZE.match(text)
    if not m:
        raise ValueError(f"no size: {text!r}")
    n, unit, binary = m.groups()
    thousand = unit and not binary and text.strip().lower().endswith("b")
    power = " kmgt".index(unit.lower()) if unit else 0
    return int(float(n) * (1000 if thousand else 1024) ** power)


def parse_index_list(text: str, most: int = 255) -> list[int]:
    """`1,3,5-7` as sorted distinct numbers; 0, numbers over `most` and reversed ranges are errors."""
    out: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"no index or range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if not 1 <= a <= b <= most:
            raise ValueError(f"index out of 1..{most}: {part!r}")
        out.update(range(a, b + 1))
    return sorted(out)


def line_and_column(text: str, offset: int) -> tuple[int, int]:
    """1-based line and column of a byte offset in a text."""
    before = text.encode()[:offset].decode(errors="replace")
    return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1


def title(name: Column) -> Column:
    """A disc's title as archives keep it: at most 255 characters."""
    return F.substring(name, 1, 255)


def fits_in_memory(available: Column, data: Column) -> Column:
    """Whether an archive's data may be held in memory while it is made: four fifths of what is available exceed the data, a copy of up to
    2^32 - 1 bytes of it, and as many bytes again. The engine doesn't ask, since stages are written; callers of bounded jobs may."""
    most = F.lit(2**32 - 1)
    return F.lit(0.8) * available > data + F.least(data, most) + most
