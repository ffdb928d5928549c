"""Optical-disc sectors: kinds, error-detection and error-correction codes, classification and rebuilding, by NumPy on batches."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTOR_BYTES = 2352
#: Fixed values. kind: (user data bytes, saved exception bytes, pregap, mode, first byte of user data, of the 8 extra bytes)
KINDS = {
    "Audio": (2352, 0, False, "AUDIO", 0, None),
    "PregapAudio": (2352, 0, True, "AUDIO", 0, None),
    "ZeroedAudio": (2352, 0, False, "AUDIO", 0, None),
    "Mode1": (2048, 0, False, "MODE1/2352", 16, 2068),
    "Mode1Exception": (2048, 296, False, "MODE1/2352", 16, 2068),
    "PregapMode1": (2048, 0, True, "MODE1/2352", 16, 2068),
    "PregapMode1Exception": (2048, 296, True, "MODE1/2352", 16, 2068),
    "ZeroedMode1Data": (2352, 0, False, "MODE1/2352", 0, 2068),
    "Mode2Form1": (2048, 0, False, "MODE2/2352", 24, 16),
    "Mode2Form1Exception": (2048, 296, False, "MODE2/2352", 24, 16),
    "PregapMode2": (2048, 0, True, "MODE2/2352", 24, 16),
    "PregapMode2Exception": (2048, 296, True, "MODE2/2352", 24, 16),
    "Mode2Form2": (2324, 0, False, "MODE2/2352", 24, 16),
    "Mode2Form2Exception": (2324, 20, False, "MODE2/2352", 24, 16),
    "ZeroedMode2Data": (2352, 0, False, "MODE2/2352", 0, 2068),
    "None": (0, 0, False, "AUDIO", 0, None),
}
SYNC = np.frombuffer(bytes([0] + [255] * 10 + [0]), dtype=np.uint8)


def _by_kind(kind: Column, value) -> Column:
    out = None
    for k, row in KINDS.items():
        v = F.lit(value(row))
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def data_size(kind: Column) -> Column:
    return _by_kind(kind, lambda r: r[0])


def exception_size(kind: Column) -> Column:
    return _by_kind(kind, lambda r: r[1])


def is_pregap(kind: Column) -> Column:
    return kind.isin([k for k, r in KINDS.items() if r[2]])


def track_mode(kind: Column) -> Column:
    """The CUE text of the track a sector kind belongs to."""
    return _by_kind(kind, lambda r: r[3])


def track_type(text: Column) -> Column:
    """The canonical CUE track type, whatever its case; any other text is an error."""
    t = F.upper(F.trim(text))
    return F.when(text.isNull() | t.isin("AUDIO", "MODE1/2352", "MODE2/2352"), t).otherwise(F.raise_error(F.concat(F.lit("track type: "), text)).cast("string"))


def user_data(sector: Column, kind: Column) -> Column:
    """A sector's user data by its kind; audio and zeroed sectors are user data as a whole. Native byte slices."""
    out = None
    for k, r in KINDS.items():
        piece = sector.substr(r[4] + 1, r[0])
        out = F.when(kind == k, piece) if out is None else out.when(kind == k, piece)
    return out


def is_form2(sector: Column) -> Column:
    """The form bit of a mode 2 sector's subheader."""
    return F.conv(F.hex(sector.substr(19, 1)), 16, 10).cast("int").bitwiseAND(F.lit(32)) != 0


def is_zeroed(sector: Column) -> Column:
    return sector == F.unhex(F.repeat(F.lit("00"), SECTOR_BYTES))


@functools.cache
def edc_table() -> np.ndarray:
    """The reflected CRC table of the polynomial 0x8001801B, as discs use it."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xD8018001), t >> 1).astype(np.uint32)
    return t


def edc(rows: np.ndarray) -> np.ndarray:
    """The 32-bit error-detection code of each row of bytes: one table step for a column, over all rows at once."""
    t, crc = edc_table(), np.zeros(len(rows), dtype=np.uint32)
    for j in range(rows.shape[1]):
        crc = (crc >> np.uint32(8)) ^ t[(crc ^ rows[:, j]) & np.uint32(255)]
    return crc


@functools.cache
def _gf() -> tuple[np.ndarray, np.ndarray]:
    """Tables over GF(2^8) with the polynomial 0x11D: times 2, and division by 3."""
    x = np.arange(256, dtype=np.uint16)
    double = np.where(x & 128, (x << 1) ^ 0x11D, x << 1).astype(np.uint8)
    third = np.zeros(256, dtype=np.uint8)
    third[double ^ x.astype(np.uint8)] = x
    return double, third


def gf_double(x: np.ndarray) -> np.ndarray:
    return _gf()[0][x]


@functools.cache
def _parity_places() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes, counted from byte 12 of the sector, each P column (86 of 24) and Q diagonal (52 of 43) holds."""
    p = np.array([[86 * r + c for r in range(24)] for c in range(86)])
    q = np.array([[(44 * k + 43 * (d // 2)) % 1118 * 2 + d % 2 for k in range(43)] for d in range(52)])
    return p, q


def _parity(words: np.ndarray) -> np.ndarray:
    """Two parity bytes (n x lines x 2) of each line of bytes (n x lines x length): sum zero, and weighted sum zero."""
    double, third = _gf()
    a = np.zeros(words.shape[:2], dtype=np.uint8)
    b = np.zeros_like(a)
    for i in range(words.shape[2]):
        a = double[a ^ words[:, :, i]]
        b ^= words[:, :, i]
    first = third[double[a] ^ b]
    return np.stack([first, first ^ b], axis=2)


def ecc(sectors: np.ndarray, zero_header: bool) -> np.ndarray:
    """The 276 bytes of P and Q parity (bytes 2076..2352) of each sector; with zero_header bytes 12..16 count as 0 (mode 2)."""
    work = sectors[:, 12:].copy()
    if zero_header:
        work[:, :4] = 0
    p, q = _parity_places()
    pp = _parity(work[:, p])
    work[:, 2064:2150], work[:, 2150:2236] = pp[:, :, 0], pp[:, :, 1]
    qq = _parity(work[:, q])
    return np.concatenate([pp[:, :, 0], pp[:, :, 1], qq[:, :, 0], qq[:, :, 1]], axis=1)


def as_sectors(col) -> np.ndarray:
    """Binary values of 2,352 bytes as rows; another length is an error."""
    raw = b"".join(bytes(v) for v in col)
    if any(len(v) != SECTOR_BYTES for v in col):
        raise ValueError("a sector has 2352 bytes")
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, SECTOR_BYTES)


def _le32(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)


def checks(s: np.ndarray, index: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Which sectors carry the sync field, valid codes for each mode, and an address that can be made again from their index and a
    difference of at least 0 (of any, without index)."""
    mode = s[:, 15]
    good = {"sync": (s[:, :12] == SYNC).all(axis=1), "mode": mode, "form2": (s[:, 18] & 32) != 0, "zero": ~s[:, :].any(axis=1)}
    good["m1_edc"] = (_le32(edc(s[:, :2064])) == s[:, 2064:2068]).all(axis=1)
    good["m2f1_edc"] = (_le32(edc(s[:, 16:2072])) == s[:, 2072:2076]).all(axis=1)
    good["m2f2_edc"] = (_le32(edc(s[:, 16:2348])) == s[:, 2348:2352]).all(axis=1)
    good["m1_ecc"] = (ecc(s, False) == s[:, 2076:]).all(axis=1)
    good["m2_ecc"] = (ecc(s, True) == s[:, 2076:]).all(axis=1)
    minutes, seconds, frames = ((s[:, i] >> 4).astype(np.int64) * 10 + (s[:, i] & 15) for i in (12, 13, 14))
    lba = (minutes * 60 + seconds) * 75 + frames
    good["address"] = (_header(lba) == s[:, 12:15]).all(axis=1)
    if index is not None:
        good["address"] &= lba >= index
    return good


def classify(s: np.ndarray, index: np.ndarray | None = None, strict: bool = True) -> np.ndarray:
    """The kind of each data sector. Codes that don't match, or an address that can't be made again, make an exception of its mode; zero
    sectors are ZeroedMode1Data; without the sync field it is Audio. A mode other than 1 or 2 is an error, or, if not strict, an exception of
    mode 2, which keeps its header."""
    c = checks(s, index)
    out = np.full(len(s), "Audio", dtype=object)
    data = c["sync"]
    if strict and (data & ~np.isin(c["mode"], (1, 2))).any():
        raise ValueError("a data sector's mode is 1 or 2")
    m1, m2, two = data & (c["mode"] == 1), data & (c["mode"] != 1), (c["mode"] == 2) & c["address"]
    out[m1] = np.where(c["m1_edc"] & c["m1_ecc"] & c["address"], "Mode1", "Mode1Exception")[m1]
    out[m2 & ~c["form2"]] = np.where(c["m2f1_edc"] & c["m2_ecc"] & two, "Mode2Form1", "Mode2Form1Exception")[m2 & ~c["form2"]]
    out[m2 & c["form2"]] = np.where(c["m2f2_edc"] & two, "Mode2Form2", "Mode2Form2Exception")[m2 & c["form2"]]
    out[c["zero"]] = "ZeroedMode1Data"
    return out


def exception_bytes(sector: bytes, kind: str) -> bytes | None:
    """What an exceptional sector keeps besides user data and the 8 extra bytes: 296 or 20 bytes; None for other kinds."""
    if kind in ("Mode1Exception", "PregapMode1Exception"):
        return sector[:16] + sector[2064:2068] + sector[2076:]
    if kind in ("Mode2Form1Exception", "PregapMode2Exception"):
        return sector[:16] + sector[2072:]
    return sector[:16] + sector[2348:] if kind == "Mode2Form2Exception" else None


def _bcd(n: np.ndarray) -> np.ndarray:
    return ((n // 10 % 16) * 16 + n % 10).astype(np.uint8)


def _header(lba: np.ndarray) -> np.ndarray:
    """The three bytes of each address."""
    return np.stack([_bcd(lba // 4500), _bcd(lba // 75 % 60), _bcd(lba % 75)], axis=1)


def rebuild(kind: str, data: np.ndarray, extra: np.ndarray, lba: np.ndarray, saved: np.ndarray | None = None) -> np.ndarray:
    """Sectors of one kind from user data, the 8 extra bytes, their addresses (frames) and, for exceptions, the saved bytes."""
    n, (size, _, _, mode, at, extra_at) = len(data), KINDS[kind]
    s = np.zeros((n, SECTOR_BYTES), dtype=np.uint8)
    if size == SECTOR_BYTES:
        s[:] = data
        return s
    s[:, at : at + size] = data
    s[:, extra_at : extra_at + 8] = extra
    one = mode.startswith("MODE1")
    if saved is not None and saved.shape[1]:
        s[:, :16] = saved[:, :16]
        if kind == "Mode2Form2Exception":
            s[:, 2348:] = saved[:, 16:]
        elif one:
            s[:, 2064:2068], s[:, 2076:] = saved[:, 16:20], saved[:, 20:]
        else:
            s[:, 2072:] = saved[:, 16:]
        return s
    s[:, :12] = SYNC
    s[:, 12:15], s[:, 15] = _header(lba), 1 if one else 2
    if one:
        s[:, 2064:2068] = _le32(edc(s[:, :2064]))
        s[:, 2076:] = ecc(s, False)
    elif kind == "Mode2Form2":
        s[:, 2348:] = _le32(edc(s[:, 16:2348]))
    else:
        s[:, 2072:2076] = _le32(edc(s[:, 16:2072]))
        s[:, 2076:] = ecc(s, True)
    return s


@F.pandas_udf(T.StringType())
def sector_kind(sector: pd.Series, index: pd.Series) -> pd.Series:
    """classify of a sector and its index as a column function, where no mode is an error; null gives null."""
    out = pd.Series([None] * len(sector), dtype=object)
    there = np.flatnonzero(sector.notna())
    if len(there):
        out.iloc[there] = classify(as_sectors(list(sector.iloc[there])), index.iloc[there].to_numpy(np.int64), strict=False)
    return out


@F.pandas_udf(T.BinaryType())
def sector_exception(sector: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or k is None else exception_bytes(bytes(s), k) for s, k in zip(sector, kind)], dtype=object)


@F.pandas_udf(T.LongType())
def edc_of(data: pd.Series) -> pd.Series:
    """The error-detection code of any bytes; of none it is 0, of null null."""
    out = pd.Series([None] * len(data), dtype="Int64")
    sizes = np.array([-1 if d is None else len(d) for d in data])
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        grid = np.frombuffer(b"".join(bytes(data.iloc[i]) for i in at), np.uint8).reshape(len(at), n)
        out.iloc[at] = edc(grid).astype(np.int64)
    return out


@F.pandas_udf(T.BooleanType())
def ecc_ok(sector: pd.Series) -> pd.Series:
    """Whether a sector's parity fits, with the header zeroed for mode 2; null gives null."""
    out = pd.Series([None] * len(sector), dtype=object)
    there = np.flatnonzero(sector.notna())
    if len(there):
        s = as_sectors(list(sector.iloc[there]))
        c1, c2 = (ecc(s, z) == s[:, 2076:] for z in (False, True))
        out.iloc[there] = [bool(a.all() if m == 1 else b.all()) for a, b, m in zip(c1, c2, s[:, 15])]
    return out
